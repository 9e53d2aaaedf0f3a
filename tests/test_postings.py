import random

import pytest
from pyspark.sql import functions as F

from petrel.operators import postings


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = ["Sprite", "table", "loop", "ÉCRAN", "straße", "𝒳𝒴𝒵", "a%b", "x_y", "ab"]
    rows = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [("null", None), ("empty", ""), ("lines", "one\ntwo\nthree"), ("long", "q" * 40_000 + "needle")]
    return spark.createDataFrame(rows, "path string, content string")


def scan(docs, query):
    at = F.instr(F.lower("content"), F.lower(F.lit(query))) - 1
    return docs.select("path", at.alias("match_at")).where("match_at >= 0")


@pytest.mark.parametrize("query", ["sprite table", "écran", "STRASSE", "straße l", "𝒴𝒵 ", "a%b x_y", "ab", "x", "", "e\nt", "needle", "nothing like it", "aaa", "loop loop loop"])
def test_equals_the_scan(docs, rows, query):
    index = postings.postings(docs)
    assert rows(postings.containing(docs, index, query)) == rows(scan(docs, query))


def test_a_search_reads_few_files_and_few_texts(spark, docs, tmp_path):
    path = f"{tmp_path}/index"
    postings.write_postings(docs, path)
    index = spark.read.parquet(path)
    found = postings.candidates(index, "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan  # folders by bucket, row groups by trigram
    places = spark.createDataFrame([(g,) for g in postings.query_grams(spark, "needle")], "gram string").select(postings.bucket(F.col("gram")).alias("b"))
    read = index.where(F.col("bucket").isin([r["b"] for r in places.collect()]))
    read.collect()
    assert 0 < read._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() <= 4 < len(index.inputFiles())
    assert [r["key"] for r in found.collect()] == ["long"]
    assert [tuple(r) for r in postings.containing(docs, index, "NEEDLE").collect()] == [("long", 40_000)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "path string, content string")
    assert postings.containing(none, postings.postings(none), "abc").count() == 0

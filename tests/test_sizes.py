"""Cases that only larger tables have: addresses beyond 64 KiB, many partitions, prefixes that fit many."""

from pyspark.sql import functions as F

from petrel.functions import text as T
from petrel.operators import decode, fold, heuristics, memdiff, postings
from petrel.sources import files


def test_addresses_of_five_digits_stay_whole(spark):
    r = spark.createDataFrame([(0x10110,), (0xD0,)], "a long").select(T.hex_label(F.col("a")).alias("h"), T.hex_label(F.col("a"), 2).alias("two")).collect()
    assert [tuple(x) for x in r] == [("$10110", "$10110"), ("$00D0", "$D0")]


def test_gaps_beyond_the_image_are_read_whole(spark, rows):
    lines = spark.createDataFrame([("f", 1, "; gap $FFF0-$10010"), ("f", 2, "; gap $1000-$2000bytes"), ("f", 3, "; gap $2000-$1000")], "source_file string, line_no long, line string")
    assert rows(files.parse_listing(lines)["gaps"].select("gap_start", "gap_end")) == [(0x1000, 0x2000), (0xFFF0, 0x10010)]


def test_numbers_are_one_to_n_in_order_over_many_partitions(spark):
    log = spark.range(0, 40_000, 1, 16).select(F.col("id").cast("string").alias("id"), F.pmod(F.col("id") * 7919, F.lit(40_009)).alias("at"))
    late = log.where("at % 9 = 0").withColumn("at", F.col("at") + 100_000)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set(key, "false")
    try:
        got = sorted((r["log_pos"], r["at"]) for r in fold.number_log(log.unionByName(late), "at").select("log_pos", "at").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset(key)
    assert [n for n, _ in got] == list(range(1, 40_001)) and [a for _, a in got] == sorted(a for _, a in got)


def test_a_prefix_that_fits_many_makes_no_pairs(spark):
    n = 3000
    h = spark.range(n).select(F.concat(F.lit("hyp-"), "id").alias("hyp_id"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("open").alias("status"), F.array().cast("array<string>").alias("evidence"))
    u = spark.range(n).select(F.lit("hyp-").alias("ref"), F.lit("lost").alias("status"), F.array(F.lit("no")).alias("evidence"), F.col("id").alias("log_pos"))
    u = u.unionByName(spark.createDataFrame([("hyp-2999", "kept", ["x"], n), ("hyp-299", "exact", ["y"], n + 1)], u.schema))
    made = fold.hypothesis_states(h, u)
    assert {r["hyp_id"]: r["status"] for r in made.where("status <> 'open'").collect()} == {"hyp-2999": "kept", "hyp-299": "exact"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ref" not in plan  # what a prefix fits is settled before it meets updates, not on their pairs


def test_labels_of_a_long_listing_are_placed_by_growing_frames(spark, rows):
    lines = spark.createDataFrame([("f", 1, "a:"), ("f", 2, "; note"), ("f", 3, "b:"), ("f", 4, "1000 60 rts"), ("f", 5, "c:"), ("g", 1, "d:")], "source_file string, line_no long, line string")
    labels = files.parse_listing(lines)["labels"]
    assert rows(labels.select("name", "addr", "ord")) == [("a", 0x1000, 1), ("b", 0x1000, 3), ("c", 0x1000, 5)]
    assert "unboundedfollowing" not in labels._jdf.queryExecution().optimizedPlan().toString().lower()


def image_rows(spark, image):
    short = bytes(range(256)) * 3 + b"\x4c"  # ends inside an instruction
    return spark.createDataFrame([("d0", bytearray(image)), ("d1", bytearray(short)), ("d2", bytearray(b"")), ("d3", bytearray(b"\x8d\x00"))], "dump_id string, content binary")


def exchanges(df):
    """Shuffles by address or of single bytes would be exchanges of the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_images_decode_as_their_bytes_do_without_a_shuffle(spark, rows, image):
    d = image_rows(spark, image)
    by_bytes, whole = decode.decode_all(decode.dump_bytes(d)), decode.decode_images(d)
    assert rows(whole.drop("points_to", "into_start")) == rows(by_bytes) and exchanges(whole) == 0
    assert rows(heuristics.data_refs(whole)) == rows(heuristics.data_refs(by_bytes))
    assert rows(heuristics.self_modifying(whole)) == rows(heuristics.self_modifying(by_bytes)) and exchanges(heuristics.self_modifying(whole)) == 0


def test_walks_of_images_equal_those_of_decoded_rows(spark, rows, image):
    d = image_rows(spark, image)
    cells = decode.dump_bytes(d)
    by_bytes = decode.decode_all(cells)
    entries = spark.createDataFrame([("d0", 0xC000), ("d0", 0x0801), ("d1", 0), ("d3", 0)], "dump_id string, entry int")
    for start in (0, 0xC000):
        assert rows(decode.linear_images(d, start, 50)) == rows(decode.linear(by_bytes, start, 50)) and exchanges(decode.linear_images(d, start, 50)) == 0
    for more in ({}, {"most": 3}, {"vectors_too": False, "most": decode.IMAGE}):
        assert rows(decode.recursive_images(d, entries, **more)) == rows(decode.recursive(by_bytes, cells, entries, **more))
    assert rows(decode.image_lines(d)) == rows(decode.memory_lines(cells)) and exchanges(decode.image_lines(d)) == 0


def test_diffs_of_images_equal_those_of_their_bytes(spark, rows, image):
    other = bytearray(image)
    for at in (0x10, 0x11, 0x0400, 0xD020, 0xDD00, 0xFFFF):
        other[at] ^= 0x81
    d = spark.createDataFrame([("a", bytearray(image)), ("b", other), ("c", bytearray(image[:0x11]))], "dump_id string, content binary")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "a"), (4, "a", "gone"), (5, "gone", "b")], "pair_id long, a string, b string")
    summary, shown = memdiff.named_diff(decode.dump_bytes(d).withColumnRenamed("dump_id", "name"), pairs, shown=3)
    found = memdiff.image_diffs(d, pairs, shown=3)
    assert sorted(tuple(r) for r in found.drop("shown").collect()) == sorted(tuple(r) for r in summary.select("pair_id", "problem", "changed", "by_region").collect())
    assert rows(found.select("pair_id", F.explode("shown").alias("s")).select("pair_id", "s.*")) == rows(shown.select("pair_id", "addr", "old", "new"))


def test_trigrams_are_cut_once_per_text(spark):
    texts = [("Abcabc",), ("ab",), ("",), (None,), ("a\n\U0001f600Ü",)]
    made = spark.createDataFrame(texts, "t string").select(postings.trigrams(F.col("t")).alias("g"))
    assert [r["g"] for r in made.collect()] == [["abc", "bca", "cab"], [], [], None, ["a\n\U0001f600", "\n\U0001f600ü"]]
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()  # five passes over a text by interpreted functions

import pytest
from pyspark.sql import functions as F

from petrel.plans import surface
from petrel.plans.sqlmode import Rejected


@pytest.fixture(scope="module")
def views(spark):
    of = spark.createDataFrame
    return {
        "code_routines": of([(0x1000, 0x10FF, "sub_1000"), (0x1010, 0x101F, "inner"), (0x2000, 0x20FF, None)], "start_addr int, end_addr int, name string"),
        "code_xrefs": of([(0x2000, 0x1000, "jsr"), (0x2003, 0x1000, "jsr"), (0x2000, 0x1000, "jsr"), (0x1011, 0x2000, "jmp")], "src_addr int, dst_addr int, kind string"),
        "code_data_refs": of([(0x1000, 0xD020, "w", "x", False), (0x1003, 0xD020, "r", None, False), (0x1003, 0xD020, "r", None, False), (0x1006, 0x00FB, "rmw", "y", True)], "src_addr int, dst_addr int, access string, index_reg string, indirect boolean"),
        "code_smc_sites": of([(0x1003, 0x1010, "direct"), (0x1000, 0x1010, "direct")], "src_addr int, dst_addr int, smc_kind string"),
        "instructions": of([(0x1000, "8D20D0", "sta", "$D020", 3), (0x1003, "4C0020", "jmp", "$2000", 3), (0x2000, "60", "rts", "", 1)], "addr int, bytes_hex string, mnemonic string, operand string, size_bytes int"),
        "code_labels": of([(0x2000, "done"), (0x2000, "end_of_it")], "addr int, name string"),
        "hypotheses": of([("h1", 1, 0x1000, 0x10FF, "t", "draw", 0.7, "m", "[]"), ("h2", 2, 0x1000, 0x2000, "g", "group", 0.5, "m", "[]"), ("h3", 2, 0x2000, 0x2000, "g", "other", 0.9, "m", "[]")], "annotation_id string, layer int, start_addr int, end_addr int, text string, name_suggestion string, confidence double, producer string, flags_json string"),
        "annotations": of([("c1", 3, "critique", 1, 2, "m", 0.5, '{"verdict": "weak"}', "[]", "[]", 4), ("c2", 3, "critique", 1, 2, "m", 0.5, "no json", "[]", "[]", 9), ("c3", 2, "critique", 1, 2, "m", 0.5, "{}", "[]", "[]", 10)], "id string, layer int, kind string, start_addr int, end_addr int, producer string, confidence double, payload_json string, evidence_json string, flags_json string, seq long"),
        "asm_docs": of([("a.asm", "x" * 300 + "Sprite loop" + "y" * 900), ("b.asm", "none"), ("c.asm", "sprite")], "path string, content string"),
        "labels": of([(0xC145, "foo", "code", 0.1), (1, "lives_counter", "data", 0.9)], "addr int, name string, kind string, confidence double"),
        "events": of([("1", "k", "2026-01-01", "{}"), ("2", "k", "2026-01-02", "{}"), ("3", "j", "2026-01-03", "{}")], "id string, kind string, ts string, payload_json string"),
        "text_docs": of([("a", "The sprite table")], "path string, content string"),
        "vectors": of([(1, "s", [1.0, 0.0], "alpha beta"), (2, "s", [0.0, 1.0], "gamma")], "id int, source string, embedding array<double>, text string"),
    }


def got(views, store, mode, *columns, **args):
    df = surface.ask(store, mode, views, **args)
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_modes_of_the_code_store(views):
    assert got(views, "code_kb", "xrefs_to", addr="$1000") == [(0x2000, "jsr"), (0x2003, "jsr")]
    assert got(views, "code_kb", "xrefs_from", start="$2000", end="$20FF") == [(0x2000, 0x1000, "jsr"), (0x2003, 0x1000, "jsr")]
    assert got(views, "code_kb", "routine", "start_addr", start="$1015") == [(0x1010,)] and got(views, "code_kb", "routine", "start_addr", start=0x1000) == [(0x1000,)]
    assert got(views, "code_kb", "routines", "start", "display_name", "callers", limit=2) == [(0x1000, "draw", 2), (0x2000, None, 1)]
    assert got(views, "code_kb", "smc", "src_addr") == [(0x1000,), (0x1003,)]
    assert got(views, "code_kb", "writes_to", addr="D020") == [(0x1000, "w", "x", False)]
    assert got(views, "code_kb", "refs_to", "src_addr", addr="D020") == [(0x1000,), (0x1003,)]
    assert got(views, "code_kb", "hardware_refs", "src_addr", "dst_addr") == [(0x1000, 0xD020), (0x1003, 0xD020)]
    assert got(views, "code_kb", "groups", "annotation_id") == [("h3",), ("h2",)]
    assert got(views, "code_kb", "critiques", "id", "verdict") == [("c2", None), ("c1", "weak")]
    assert got(views, "code_kb", "disasm", "addr", start="$1001", count=1) == [(0x1003,)]
    assert [r[0] for r in got(views, "code_kb", "pseudocode", "addr", start="$1000")] == [0x1000, 0x1003]
    assert got(views, "code_kb", "export", "label", "line")[1:] == [(None, "$1003  JMP done"), ("done:", "$2000  RTS")]
    (path, at, snippet), other = got(views, "code_kb", "search", q="SPRITE")
    assert (path, at, other[0]) == ("a.asm", 300, "c.asm") and snippet.startswith("..." + "x" * 200 + "Sprite") and snippet.endswith("...") and len(snippet) == 1006
    assert ("code_xrefs", 4) in got(views, "code_kb", "stats") and ("labels", "addr", "int") in got(views, "code_kb", "schema")
    assert got(views, "code_kb", "hardware", addr="$D020")


def test_modes_of_the_general_store(views):
    assert got(views, "kb", "labels", "addr", q="what writes $C145 and lives?") == [(0xC145,), (1,)]
    assert got(views, "kb", "events", "id", limit=2) == [("3",), ("2",)] and got(views, "kb", "events", "id", kind="k") == [("2",), ("1",)]
    assert got(views, "kb", "text", "path", q="sprite") == [("a",)]
    assert got(views, "kb", "text_semantic", "id", vector=[1.0, 0.1], terms=["alpha"])[0] == (1,)
    assert got(views, "kb", "sql", sql="SELECT address FROM labels ORDER BY confidence DESC LIMIT 1;") == [(1,)]


@pytest.mark.parametrize(("args", "why"), [({"mode": "nope"}, "unknown mode"), ({"mode": "xrefs_to"}, "needs one of"), ({"mode": "search"}, "needs q"), ({"mode": "smc", "limit": "many"}, "not an integer"), ({"mode": "smc", "limit": 0}, "not in")])
def test_bad_calls_say_so(views, args, why):
    with pytest.raises(ValueError, match=why):
        surface.ask("code_kb", views=views, **args).collect()
    with pytest.raises(ValueError, match="needs the views"):
        surface.ask("code_kb", "groups", {"labels": views["labels"]})


@pytest.mark.parametrize("sql", [
    "SELECT count(*) AS n FROM labels", "WITH a AS (SELECT * FROM labels) SELECT count(*) AS n FROM a", "SELECT 2 AS n", "SELECT count(*) AS n FROM (VALUES (1), (2)) t(x)",
    "SELECT (SELECT count(*) FROM labels) AS n", "SELECT count(*) AS n FROM labels WHERE addr IN (SELECT addr FROM labels)", "SELECT count(*) AS n FROM labels LATERAL VIEW explode(array(1)) AS e",
])
def test_queries_over_views(spark, views, sql):
    df, n, _ = surface.query(spark, sql, views)
    assert n == 1 and df.first()["n"] == 2


@pytest.mark.parametrize("sql", [
    "SHOW TABLES", "SET x = 1", "DESCRIBE labels", "SELECT * FROM range(5)", "SELECT * FROM labels, range(3)", "SELECT (SELECT max(id) FROM range(9)) AS n", "WITH a AS (SELECT * FROM range(3)) SELECT * FROM a",
    "SELECT * FROM other", "SELECT * FROM labels WHERE addr IN (SELECT x FROM other)", "EXPLAIN SELECT 1", "CACHE TABLE labels", "INSERT INTO labels VALUES (1)", "SELECT 1; SELECT 2",
])
def test_all_else_is_rejected(spark, views, tmp_path_factory, sql):
    spark.range(3).withColumnRenamed("id", "x").createOrReplaceTempView("other")
    with pytest.raises(Exception, match="allow|only|no such view|may not|PARSE|Rejected"):
        surface.query(spark, sql, views)
    spark.catalog.dropTempView("other")


def test_files_are_no_tables(spark, views, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/p")
    for sql in (f"SELECT * FROM parquet.`{tmp_path}/p`", f"SELECT count(*) AS n FROM labels WHERE addr < (SELECT max(id) FROM parquet.`{tmp_path}/p`)"):
        with pytest.raises(Rejected, match="only the views"):
            surface.query(spark, sql, views)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):  # views go with the call
        spark.sql("SELECT * FROM labels").select(F.col("addr")).collect()

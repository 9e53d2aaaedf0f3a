import importlib

import pytest

from petrel.plans import modes, registry


def test_entry_and_registration(spark):
    e = importlib.import_module("__spark_entry__")
    assert registry.QUERIES.keys() <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()
    assert e.entry(spark).count() > 0


def test_dispatch(spark, image):
    d = spark.createDataFrame([("d0", bytearray(image))], "dump_id string, content binary")
    assert [r["addr"] for r in modes.dispatch(d, "recursive").orderBy("ord").limit(3).collect()] == [0xC000, 0xC003, 0xC006]
    assert modes.dispatch(d, "smc").first()["site"] == 0xC000
    assert "unknown mode" in modes.dispatch(d, "nope").first()["error"]
    assert modes.dispatch(d, "vectors").count() == 6


def test_loops_then_listing(spark):
    mem = bytearray(0x10000)
    mem[0x1000:0x100C] = bytes([0xAD, 0x12, 0xD0, 0x20, 0x00, 0x20, 0x20, 0x00, 0x30, 0x4C, 0x00, 0x10])
    ranked, listing = modes.loops_with_listing(spark.createDataFrame([("d0", mem)], "dump_id string, content binary"))
    assert ranked.where("place = 1").first()["top"] == 0x1000 and listing.where("addr between 4096 and 4107").count() == 4


def test_arguments():
    assert modes.as_int("7", 1, 0, 9) == 7 and modes.as_int(None, 3, 0, 9) == 3 and modes.as_bool("true") and not modes.as_bool(None)
    for bad in (True, "x", 99):
        with pytest.raises(ValueError):
            modes.as_int(bad, 1, 0, 9)
    assert modes.seeds([{"addr": "$C000", "label": "main"}, 0, "1000", None, True]) == [(0xC000, "main"), (0x1000, "seed_1000")]
    assert modes.session_folder("Bruce Lee!", ["bruce_lee"]) == "bruce_lee" and modes.session_folder("A  b", []) == "a-b"
    assert modes.hardware_text().startswith("VIC-II") and modes.report({"question": "q", "confidence": 0.5}).startswith("# q")


def test_contract(spark):
    df = spark.createDataFrame([('{"answer": "x", "confidence": "high"}',)], "answer string")
    assert df.select(modes.contract_errors(df, {"answer": "text", "confidence": "number", "steps": "list"}).alias("e")).first()["e"] == ["confidence is no number", "steps is missing"]

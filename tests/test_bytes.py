from pyspark.sql import functions as F

from petrel.functions import isa
from petrel.functions import text as T
from petrel.operators import decode, heuristics, layer0, memdiff
from petrel.sources import files, sinks


def code(spark, *insns):
    return spark.createDataFrame([("d", a, m, op) for a, m, op in insns], "dump_id string, addr int, mnemonic string, op_str string")


def dump(spark, *images):
    return spark.createDataFrame([(f"d{i}", bytearray(m)) for i, m in enumerate(images)], "dump_id string, content binary")


def test_opcodes():
    assert len(isa.opcodes()) == 151
    assert isa.opcodes()[0xB1] == ("lda", "indy") and isa.opcodes()[0x96] == ("stx", "zpy") and 0x9E not in isa.opcodes()


def test_image_facts(spark, image, rows):
    d = dump(spark, image)
    cells = decode.dump_bytes(d)
    assert cells.count() == 0x10000
    assert decode.boot_targets(d).first()["boot_target"] == 0xC000
    all_of = decode.decode_all(cells)
    lin = decode.linear(all_of, 0xC000, 3)
    assert [tuple(r) for r in lin.orderBy("ord").select("addr", "mnemonic", "op_str").collect()] == [(0xC000, "sta", "0xc000"), (0xC003, "jsr", "0xc010"), (0xC006, "rts", "")]
    rec = decode.recursive(all_of, cells, spark.createDataFrame([("d0", 0xC000)], "dump_id string, entry int"))
    assert [r["addr"] for r in rec.orderBy("ord").collect()] == [0xC000, 0xC003, 0xC006, 0xC010, 0xC013]
    capped = decode.recursive(all_of, cells, spark.createDataFrame([("d0", 0xC000)], "dump_id string, entry int"), most=2)
    assert capped.count() == 2
    assert [(r["site"], r["kind"]) for r in heuristics.self_modifying(rec).collect()] == [(0xC000, "absolute_into_code")]
    assert decode.banking(d).first()["kernal_rom_visible"]
    assert rows(decode.gaps(rec).select("addr", "gap_start", "gap_end")) == [(0xC010, 0xC007, 0xC00F)]
    assert [r["address"] for r in decode.entry_candidates(d).collect()] == [0xC000]


def test_short_image_and_clipped_read(spark):
    d = dump(spark, b"\x01\x02\x03")
    assert decode.dump_bytes(d).count() == 3 and decode.dump_bytes(d, pad=True).count() == 0x10000
    assert bytes(d.select(decode.read_bytes(F.col("content"), 1, 100).alias("b")).first()["b"]) == b"\x02\x03"
    assert decode.dump_bytes(dump(spark, b"")).count() == 0


def test_data_refs(spark, rows):
    c = code(spark, (0, "sta", "0xd020"), (3, "lda", "0xd012"), (6, "inc", "0x0780, x"), (9, "lda", "#0x05"), (11, "lda", "(0xfb), y"), (13, "asl", "a"))
    assert rows(heuristics.data_refs(c).drop("dump_id")) == [(0, 0xD020, "w", None, False), (11, 0xFB, "r", "y", True), (3, 0xD012, "r", None, False), (6, 0x0780, "rmw", "x", False)]


def test_state_variables(spark):
    c = code(spark, (0, "dec", "0x00c0"), (3, "sed", ""), (4, "sta", "0x0340"), (7, "cld", ""), (8, "ora", "#0x30"), (10, "sta", "0x0412"), (13, "inc", "0x0350"), (16, "lda", "0x0350"), (19, "cmp", "#0x0a"), (21, "inc", "0xd020"), (24, "dec", "(0x10)"))
    found = {r["addr"]: (r["kind"], r["score"], r["alias_kinds"]) for r in heuristics.state_variables(c).collect()}
    assert found == {0xC0: ("lives", 12.0, ["timer"]), 0x0340: ("score", 18.0, []), 0x0412: ("hud_digit", 10.0, []), 0x0350: ("multibyte_counter", 14.0, ["counter", "timer"])}


def test_idioms(spark):
    c = code(
        spark, (0, "lda", "0xd012"), (3, "cmp", "#0x80"), (5, "bne", "0x0000"), (7, "dex", ""), (8, "bne", "0x0007"), (10, "lda", "0x2000, x"), (13, "sta", "0x3000, x"), (16, "inx", ""),
        (17, "bne", "0x000a"), (19, "asl", "a"), (20, "tax", ""), (21, "jmp", "(0x00fb)"), (24, "jsr", "0xffd2"), (27, "sta", "0xd400"), (30, "sta", "0xd401"), (33, "sta", "0xd404"),
    )
    assert {(r["addr"], r["idiom"]) for r in heuristics.idioms(c).collect()} == {(0, "raster_wait"), (7, "delay_loop"), (10, "memcpy"), (19, "jump_table"), (24, "kernal_trampoline"), (27, "sid_tick")}


def test_loops(spark):
    c = code(spark, (0x1000, "lda", "0xd012"), (0x1003, "jsr", "0x2000"), (0x1006, "jsr", "0x3000"), (0x1009, "jmp", "0x1000"))
    none = spark.createDataFrame([], "dump_id string, target int")
    top = heuristics.loop_candidates(c, none, none).first()
    # calls 8, distinct targets 5, raster 30, video chip 10, closing jump 25, region 10
    assert (top["top"], top["end"], top["score"], top["source"]) == (0x1000, 0x1009, 88.0, "backward_jmp")


def test_screen(spark, rows):
    mem = bytearray(0x800)
    mem[0x0400:0x0408] = bytes([8, 9, 32, 19, 3, 15, 18, 5])
    mem[0x0428:0x042A] = bytes([1, 2])
    assert rows(heuristics.screen_runs(decode.dump_bytes(dump(spark, mem))).select("addr", "row", "col", "text")) == [(0x0400, 0, 0, "HI SCORE")]


def test_diff_and_series(spark):
    a, b = bytearray(0x10000), bytearray(0x10000)
    a[0xC0], b[0xC0], b[0xD012], b[0x0900] = 5, 4, 9, 200
    x, y = (decode.dump_bytes(dump(spark, m)) for m in (a, b))
    assert [(r["addr"], r["delta"], r["region"]) for r in memdiff.snapshot_diff(x, y).collect()] == [(0xC0, -1, "zero_page"), (0x0900, -56, "low_ram")]
    assert memdiff.snapshot_diff(x, y, exclude_io=False).count() == 3
    series = spark.createDataFrame([("g", i, at, v) for i in range(4) for at, v in ((0xC0, 5 - i), (0x0900, i * i), (0xD012, 9 - i))], "dump_id string, snap_ix int, addr int, b int")
    assert [(r["addr"], r["values"]) for r in memdiff.monotonic_scan(series).collect()] == [(0xC0, [5, 4, 3, 2])]
    assert memdiff.monotonic_scan(series.where("snap_ix = 0")).count() == 0


def test_anchors_and_sites(spark, image):
    cells = decode.dump_bytes(dump(spark, image))
    assert [r["site"] for r in memdiff.reference_sites(cells, 0xC010).collect()] == [0xC003]
    want = spark.createDataFrame([("c", "d0", 0xC000), ("c", "d0", 0x5000)], "case_id string, dump_id string, addr int")
    listing = spark.createDataFrame([("d0", 0xC000, "8D 00 C0")], "dump_id string, addr int, bytes_hex string")
    assert {r["addr"]: r["ok"] for r in memdiff.validate_anchors(want, cells, listing).collect()} == {0xC000: True, 0x5000: False}


LISTING = """; routine bank
; gap $1010-$101f
entry_main:
1000  A9 01     LDA #$01
1002  20 20 10  JSR drawScore ; call
1005  60        RTS
tail:
1006  EA        NOP
drawScore:
1020  8D 20 D0  STA 0xd020
1023  60        RTS
what is this
after:
"""


def test_listing_pipeline(spark, rows):
    lines = files.split_lines(spark.createDataFrame([("f", LISTING)], "source_file string, content string"), "source_file")
    p = files.parse_listing(lines)
    assert rows(p["labels"].select("addr", "name")) == [(0x1000, "entry_main"), (0x1006, "tail"), (0x1020, "drawScore"), (0x1023, "after")]
    assert tuple(p["counters"].select("total_lines", "skipped_lines").first()) == (14, 1)
    assert rows(p["gaps"].select("gap_start", "gap_end")) == [(0x1010, 0x101F)]
    assert "$D020" in [r["operand"] for r in p["instructions"].collect()]
    facts = layer0.build(p["instructions"], p["labels"], p["gaps"])
    got = {r["start_addr"]: (r["end_addr"], r["name"], r["exits"]) for r in facts["routines"].collect()}
    assert got == {0x1000: (0x1005, "entry_main", [0x1005]), 0x1006: (0x1006, "tail", []), 0x1020: (0x1023, "drawScore", [0x1023])}
    assert rows(facts["xrefs"].select("src", "dst", "edge")) == [(0x1002, 0x1020, "jsr")]
    assert rows(layer0.window_context(p["instructions"], 0x1000).select("addr")) == [(0x1000,), (0x1002,), (0x1005,)]
    text = [r["line"] for r in sinks.commented_listing(p["instructions"], facts["routines"].withColumn("confidence", F.lit(0.6)), p["labels"], spark.createDataFrame([], "start_addr int, name string, confidence double")).collect()]
    assert text[0] == "entry_main: [med]" and "; gap $1007-$101F" in text and any(x.endswith("JSR drawScore") for x in text)


def test_trace(spark):
    text = [".C:1000  A9 01     LDA #$01    - A:00 X:00", ".C:1001  01 8D     ORA ($8D,X) - A:01", ".C:1000  A9 02     LDA #$02 - A:01", "(break)", ".C:1005  60 RTS - A"]
    t = files.trace_rows(spark.createDataFrame([("t", i, x) for i, x in enumerate(text)], "trace_id string, line_no int, line string"))
    r = {x["addr"]: (x["operand"], x["inside_of"], x["contains"]) for x in heuristics.reduce_trace(t).collect()}
    assert r == {0x1000: ("#$01", None, [0x1001]), 0x1001: ("($8D,X)", [0x1000], None), 0x1005: ("", None, None)}


def test_pseudocode_and_writers(spark, image):
    c = code(spark, (0, "lda", "#0x05"), (2, "xyz", "0x10"), (4, "jsr", "0xc010"))
    assert [r["statement"] for r in heuristics.pseudocode(c).orderBy("addr").collect()] == ["A = #$05", "asm(xyz $10)", "call $c010"]
    stops = spark.createDataFrame([("d0", 0xC013, 0, 0, 0xC020)], "dump_id string, pc int, x int, y int, watched int")
    assert [(r["site"], r["mnemonic"]) for r in heuristics.writers_to(stops, decode.dump_bytes(dump(spark, image))).collect()] == [(0xC010, "inc")]


def test_hardware_lookup(spark):
    p = spark.createDataFrame([(0xD020,), (0xD030,), (0x1000,)], "addr int")
    assert {r["addr"]: (r["register"], r["chip"]) for r in layer0.hardware(p).collect()} == {0xD020: ("EXTCOL", "VIC-II"), 0xD030: (None, "VIC-II"), 0x1000: (None, None)}


def test_operand_expressions(spark):
    def one(f, *values):
        return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]

    assert one(T.parse_address, "$C000", "0xd020", "12", "12345", "", None) == [0xC000, 0xD020, 0x12, None, None, None]
    assert one(T.parse_address_lenient, "$10", "10", "ff", "65537", "zz") == [16, 10, 255, 1, None]
    assert one(T.canonical_operand, "0xd020,x ; border", "#$0a", "label") == ["$D020,x", "#$0A", "label"]
    assert one(T.store_target, "0xc000", "$12", "$c000,x", "#$10") == [0xC000, None, 0xC000, None]
    assert one(T.label_ref, "drawScore", "table,x", "a", "$10") == ["drawScore", "table", None, None]

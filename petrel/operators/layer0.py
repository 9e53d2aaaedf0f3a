"""Listings to layer-0 facts: labels, routines, edges, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrel.functions import isa
from petrel.functions import text as T

from .heuristics import data_refs, self_modifying


def _boundary_name(c):
    return F.lower(c).startswith("sub_") | F.lower(c).startswith("entry")


def routines(code: DataFrame, labels: DataFrame, gaps: DataFrame, key: str = "source_file") -> DataFrame:
    """``start_addr, end_addr, name, entries, exits`` per source.

    A routine starts at the first instruction, after a gap, at a label named like a routine,
    at a called address, and at a labelled instruction after a terminator.

    ``code``: ``key, addr, mnemonic, operand, size``; ``labels``: ``key, addr, name, ord``;
    ``gaps``: ``key, gap_start, gap_end``.
    """
    w = Window.partitionBy(key).orderBy("addr")
    by_addr = labels.groupBy(key, "addr").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("_l"))
    calls = code.where(F.col("mnemonic") == "jsr").select(key, F.coalesce(T.direct_target(F.col("operand")), F.lit(None).cast("int")).alias("addr"), T.label_ref(F.col("operand")).alias("name"))
    named = symbols(labels, key)
    called = calls.where("addr is not null").select(key, "addr").unionByName(calls.where("name is not null").select(key, "name").join(named, [key, "name"]).select(key, "addr")).distinct().withColumn("_called", F.lit(True))
    line = code.select(key, F.col("addr").alias("_at"), "addr").unionByName(gaps.select(key, F.col("gap_end").alias("_at"), F.lit(None).cast("int").alias("addr")))
    later = F.min("addr").over(Window.partitionBy(key).orderBy("_at").rangeBetween(1, Window.unboundedFollowing))
    after = line.withColumn("_next", later).where("addr is null and _next is not null").select(key, F.col("_next").alias("addr")).distinct().withColumn("_gap", F.lit(True))
    rows = code.join(by_addr, [key, "addr"], "left").join(called, [key, "addr"], "left").join(after, [key, "addr"], "left")
    before = F.lag("mnemonic").over(w)
    yes = lambda c: F.coalesce(c, F.lit(False))
    start = before.isNull() | yes(F.col("_called")) | yes(F.col("_gap")) | yes(F.exists("_l", lambda x: _boundary_name(x["name"]))) | (yes(before.isin(*isa.TERMINATORS)) & F.col("_l").isNotNull())
    rows = rows.withColumn("_n", F.sum(start.cast("int")).over(w))
    g = rows.groupBy(key, "_n").agg(
        F.min("addr").alias("start_addr"), F.max_by(F.col("addr") + F.col("size") - 1, "addr").alias("end_addr"), F.min_by("_l", "addr").alias("_first"), F.min_by(F.col("addr"), "addr").alias("_at"),
        F.array_sort(F.collect_set(F.when(F.col("_l").isNotNull(), F.col("addr")))).alias("_entries"), F.array_sort(F.collect_list(F.when(F.col("mnemonic").isin(*isa.TERMINATORS), F.col("addr")))).alias("exits"),
    )
    first_of = lambda a: F.when(F.size(a) > 0, a[0]["name"])
    own = F.coalesce("_first", F.array().cast("array<struct<ord:int,name:string>>"))
    name = F.coalesce(first_of(F.filter(own, lambda x: _boundary_name(x["name"]))), first_of(own), F.concat(F.lit("sub_"), F.lower(T.hex_digits(F.col("start_addr"), 4))))
    return g.select(key, "start_addr", "end_addr", name.alias("name"), F.when(F.size("_entries") > 0, F.col("_entries")).otherwise(F.array("start_addr")).alias("entries"), "exits")


def symbols(labels: DataFrame, key: str = "source_file") -> DataFrame:
    """First address of each name."""
    return labels.groupBy(key, "name").agg(F.min_by("addr", "ord").alias("addr"))


def xrefs(code: DataFrame, labels: DataFrame | None = None, key: str = "source_file") -> DataFrame:
    """``src, dst, via, edge``: calls, jumps and branches; names resolve through the label table."""
    m = F.lower("mnemonic")
    edge = F.when(m == "jsr", "jsr").when(m == "jmp", F.when(T.indirect_vector(F.col("operand")).isNotNull(), "jmp_indirect").otherwise("jmp")).when(m.isin(*isa.BRANCHES), "branch")
    e = code.withColumns({"edge": edge, "dst": F.coalesce(T.direct_target(F.col("operand")), T.indirect_vector(F.col("operand"))), "_name": T.label_ref(F.col("operand"))}).where("edge is not null")
    if labels is not None:
        named = symbols(labels, key).select(key, F.col("name").alias("_name"), F.col("addr").alias("_to"))
        e = e.join(named, [key, "_name"], "left").withColumn("dst", F.coalesce("dst", "_to"))
    return e.where("dst is not null").select(key, F.col("addr").alias("src"), "dst", m.alias("via"), "edge")


def classification(code: DataFrame, gaps: DataFrame, key: str = "source_file") -> DataFrame:
    """``start, end, class``: runs of consecutive instruction starts are code; gaps, written later, are data."""
    w = Window.partitionBy(key).orderBy("addr")
    runs = code.select(key, "addr").distinct().withColumn("_i", F.col("addr") - F.row_number().over(w))
    code_runs = runs.groupBy(key, "_i").agg(F.min("addr").alias("start"), F.max("addr").alias("end")).select(key, "start", "end", F.lit("code").alias("class"))
    return code_runs.unionByName(gaps.select(key, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"), F.lit("data").alias("class")))


def build(code: DataFrame, labels: DataFrame, gaps: DataFrame, key: str = "source_file") -> dict[str, DataFrame]:
    """All layer-0 facts of parsed listings."""
    stream = code.select(F.col(key).alias("dump_id"), "addr", "mnemonic", F.col("operand").alias("op_str"))
    edges = xrefs(code, labels, key)
    return {
        "instructions": code, "labels": labels, "routines": routines(code, labels, gaps, key), "xrefs": edges, "indirect_sites": edges.where("edge = 'jmp_indirect'"),
        "smc_sites": self_modifying(stream).withColumnRenamed("dump_id", key), "data_refs": data_refs(stream).withColumnRenamed("dump_id", key), "classification": classification(code, gaps, key),
    }


def build_window(code: DataFrame, key: str = "source_file") -> dict[str, DataFrame]:
    """The same for a window disassembled on demand: no labels, routines or classification."""
    stream = code.select(F.col(key).alias("dump_id"), "addr", "mnemonic", F.col("operand").alias("op_str"))
    return {"instructions": code, "xrefs": xrefs(code, None, key), "smc_sites": self_modifying(stream).withColumnRenamed("dump_id", key), "data_refs": data_refs(stream).withColumnRenamed("dump_id", key)}


def window_context(code: DataFrame, start: int, key: str = "source_file") -> DataFrame:
    """Contiguous instructions from ``start`` up to a gap or past a terminator."""
    w = Window.partitionBy(key).orderBy("addr")
    rows = code.where(F.col("addr") >= start)
    gap = F.coalesce(F.col("addr") != F.lag(F.col("addr") + F.col("size")).over(w), F.lit(False))
    ended = F.coalesce(F.lag("mnemonic").over(w).isin(*isa.TERMINATORS), F.lit(False))
    return rows.withColumn("_b", (gap | ended).cast("int")).withColumn("_s", F.sum("_b").over(w)).where("_s = 0").drop("_b", "_s")


# A register dimension by chip window and some of its registers.
CHIPS = ((0xD000, 0xD3FF, "VIC-II"), (0xD400, 0xD7FF, "SID"), (0xDC00, 0xDCFF, "CIA1"), (0xDD00, 0xDDFF, "CIA2"))
REGISTERS = {
    0xD011: ("SCROLY", "vertical control, raster bit 8"), 0xD012: ("RASTER", "raster line"), 0xD015: ("SPENA", "sprite enable"), 0xD016: ("SCROLX", "horizontal control"),
    0xD018: ("VMCSB", "memory pointers"), 0xD019: ("VICIRQ", "interrupt status"), 0xD01A: ("IRQMASK", "interrupt enable"), 0xD020: ("EXTCOL", "border colour"),
    0xD021: ("BGCOL0", "background colour"), 0xD400: ("FRELO1", "voice 1 frequency, low"), 0xD401: ("FREHI1", "voice 1 frequency, high"), 0xD404: ("VCREG1", "voice 1 control"),
    0xD418: ("SIGVOL", "volume and filter mode"), 0xDC00: ("CIAPRA", "port A: keyboard, joystick 2"), 0xDC01: ("CIAPRB", "port B: keyboard, joystick 1"),
    0xDC0D: ("CIAICR", "interrupt control"), 0xDD00: ("CI2PRA", "port A: bank select, serial"), 0xDD0D: ("CI2ICR", "interrupt control"),
}


def hardware(points: DataFrame, point: str = "addr") -> DataFrame:
    """Points with the register, else the chip whose window holds them."""
    names = F.create_map(*[x for a, (n, r) in REGISTERS.items() for x in (F.lit(a), F.struct(F.lit(n).alias("name"), F.lit(r).alias("role")))])[F.col(point)]
    chip = F.lit(None).cast("string")
    for lo, hi, c in CHIPS:
        chip = F.when(F.col(point).between(lo, hi), c).otherwise(chip)
    return points.withColumns({"_r": names, "chip": chip}).withColumns({"register": F.col("_r.name"), "role": F.col("_r.role")}).drop("_r")


def decode_failure(point: DataFrame, code: DataFrame, byte_rows: DataFrame, key: str = "dump_id") -> DataFrame:
    """Instruction that holds an undecodable address, if its bytes still are the image's."""
    from .intervals import points_in

    spans = code.select(key, F.col("addr").alias("start"), (F.col("addr") + F.col("size") - 1).alias("end"), "mnemonic", F.lower(F.regexp_replace("bytes_hex", r"\s", "")).alias("bytes_hex"))
    hit = points_in(point, spans, "addr", (key,))
    cells = hit.select(key, "start", F.explode(F.sequence("start", "end")).alias("addr")).distinct().join(byte_rows, [key, "addr"])
    now = cells.groupBy(key, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("addr", "b"))), lambda x: F.lower(F.lpad(F.hex(x["b"]), 2, "0"))), "").alias("now"))
    return hit.join(now, [key, "start"]).where("now = bytes_hex").select(key, "addr", F.col("start").alias("inside"), "mnemonic")

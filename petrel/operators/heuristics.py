"""Findings over instruction streams: references, state variables, idioms, loops, screens, traces.

Streams have ``dump_id, addr, mnemonic, op_str`` (and ``size`` where noted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrel.functions import isa
from petrel.functions import text as T

RASTER, INPUT = (0xD011, 0xD012), (0xDC00, 0xDC01, 0xDD00, 0xDD01)
VIC, SID = (0xD000, 0xD3FF), (0xD400, 0xD7FF)


def _stream(code: DataFrame) -> DataFrame:
    f = _mode_facts() if "points_to" in code.columns else T.operand_facts(F.col("op_str"))
    return code.withColumns({"mnemonic": F.lower("mnemonic"), "dst": f["addr"], "index": f["index"], "indirect": f["indirect"]})


def _mode_facts() -> dict[str, Column]:
    """``T.operand_facts`` of code that still has its modes and operands as numbers, whose text needs no parsing."""
    mode = F.col("mode")
    memory = ~mode.isin("imm", "acc", "imp")
    return {
        "addr": F.when(memory, F.col("points_to")), "index": F.when(mode.isin("zpx", "absx", "indx"), "x").when(mode.isin("zpy", "absy", "indy"), "y"),
        "indirect": F.when(memory, mode.isin("ind", "indx", "indy")),
    }


def _order(dump: str = "dump_id") -> Window:
    return Window.partitionBy(dump).orderBy("addr")


def data_refs(code: DataFrame) -> DataFrame:
    """``dump_id, src, dst, access, index, indirect`` of every memory operand."""
    s = _stream(code).withColumn("access", isa.access_kind(F.col("mnemonic")))
    return s.where("access is not null and dst is not null").select("dump_id", F.col("addr").alias("src"), "dst", "access", "index", "indirect")


def self_modifying(code: DataFrame) -> DataFrame:
    """Stores into known instruction starts; otherwise indexed stores into program RAM.

    Code of ``decode.decode_images`` knows the starts of its image, so nothing is joined.
    """
    if "into_start" in code.columns:
        f = _mode_facts()
        target = F.when(F.col("mode").isin("abs", "absx", "absy") & (F.col("points_to") > 0xFF), F.col("points_to"))
        s = code.where(F.lower("mnemonic").isin(*isa.STORES)).withColumns({"target": target, "index": f["index"], "hit": F.col("into_start"), "wide": F.col("mode").isin("absx", "absy")})
        return _smc_sites(s.where("target is not null"))
    s = code.where(F.lower("mnemonic").isin(*isa.STORES)).withColumns({"target": T.store_target(F.col("op_str")), "index": T.operand_facts(F.col("op_str"))["index"]})
    starts = code.select("dump_id", F.col("addr").alias("target"), F.lit(True).alias("hit")).distinct()
    s = s.join(starts, ["dump_id", "target"], "left")
    return _smc_sites(s.withColumn("wide", F.col("op_str").rlike(r"^(?:0[xX]|\$)[0-9A-Fa-f]{3,4}\s*,\s*[xyXY]$")))


def _smc_sites(s: DataFrame) -> DataFrame:
    kind = F.when(F.col("hit"), "absolute_into_code").when(F.col("wide") & F.col("target").between(0x0800, 0xCFFF), "indexed_into_program_ram")
    return s.withColumn("kind", kind).where("kind is not null").select("dump_id", F.col("addr").alias("site"), F.lower("mnemonic").alias("mnemonic"), F.col("target").alias("writes_to"), "index", "kind")


def state_variables(code: DataFrame) -> DataFrame:
    """``dump_id, addr, kind, score, alias_kinds, sites``: one candidate per address.

    Kinds score as follows: decrements 12 for lives and 4 for timer, increments 8 for
    counter and 4 for timer, stores between SED and CLD 18 for score, a store to the screen
    within five instructions of adding #$30 10 for hud_digit, and an increment followed
    within eight bytes by a comparison with #$0A 14 for multibyte_counter.  The best kind
    wins, the one found first on ties.
    """
    w = _order()
    s = _stream(code)
    ram = (~F.col("indirect")) & F.col("dst").between(0x0002, 0xCFFF)
    plain = s.where(F.col("mnemonic").isin("dec", "inc") & ram)
    dec = F.col("mnemonic") == "dec"
    kinds = F.array(
        F.struct(F.when(dec, "lives").otherwise("counter").alias("kind"), F.when(dec, 12.0).otherwise(8.0).alias("points")),
        F.struct(F.lit("timer").alias("kind"), F.lit(4.0).alias("points")),
    )
    moves = plain.select("dump_id", "dst", F.col("addr").alias("site"), F.lit(0).alias("rule"), F.posexplode(kinds).alias("part", "k")).select("dump_id", "dst", "site", "rule", "part", "k.*")

    mode = F.last(F.when(F.col("mnemonic") == "sed", True).when(F.col("mnemonic") == "cld", False), True).over(w)
    one = lambda rows, rule, kind, points: rows.select("dump_id", "dst", F.col("addr").alias("site"), F.lit(rule).alias("rule"), F.lit(0).alias("part"), F.lit(kind).alias("kind"), F.lit(points).alias("points"))
    bcd = one(s.withColumn("in_bcd", mode).where(F.col("in_bcd") & F.col("mnemonic").isin(*isa.STORES) & ram), 1, "score", 18.0)

    screen_store = F.col("mnemonic").isin(*isa.STORES) & F.col("dst").between(0x0400, 0x07E7)
    ahead = F.when(screen_store, F.struct("addr", "dst"))
    digit = s.withColumn("store", F.coalesce(*[F.lead(ahead, i).over(w) for i in range(1, 6)]))
    digit = digit.where(F.col("mnemonic").isin("ora", "adc") & F.col("op_str").rlike(r"^#(?:0[xX]|\$)30\s*$") & F.col("store").isNotNull())
    hud = digit.select("dump_id", F.col("store.dst").alias("dst"), F.col("store.addr").alias("site"), F.lit(2).alias("rule"), F.lit(0).alias("part"), F.lit("hud_digit").alias("kind"), F.lit(10.0).alias("points"))

    inc = (F.col("mnemonic") == "inc") & F.col("dst").isNotNull() & ~F.col("indirect")
    ten = (F.col("mnemonic") == "cmp") & F.lower("op_str").rlike(r"(?:0x|\$)0a")
    marks = s.where(inc | ten).withColumns({"inc": F.when(inc, F.struct("addr", "dst"))})
    # a comparison uses the increment just before it and takes it away from later comparisons within reach
    marks = marks.withColumns({"last": F.last("inc", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    near = ten & F.col("last").isNotNull() & (F.col("addr") - F.col("last.addr") <= 8)
    used = marks.withColumn("near", near).where("near").withColumn("turn", F.row_number().over(Window.partitionBy("dump_id", "last.addr").orderBy("addr"))).where("turn = 1")
    rollover = used.select("dump_id", F.col("last.dst").alias("dst"), F.col("addr").alias("site"), F.lit(3).alias("rule"), F.lit(0).alias("part"), F.lit("multibyte_counter").alias("kind"), F.lit(14.0).alias("points"))

    hits = moves.unionByName(bcd).unionByName(hud).unionByName(rollover)
    by_kind = hits.groupBy("dump_id", "dst", "kind").agg(F.sum("points").alias("score"), F.min(F.struct("rule", "site", "part")).alias("found"), F.collect_set("site").alias("sites"))
    best = Window.partitionBy("dump_id", "dst").orderBy(F.desc("score"), "found")
    every = Window.partitionBy("dump_id", "dst")
    ranked = by_kind.withColumns({"turn": F.row_number().over(best), "kinds": F.collect_set("kind").over(every), "all": F.flatten(F.collect_list("sites").over(every))})
    return ranked.where("turn = 1").select(
        "dump_id", F.col("dst").alias("addr"), "kind", F.round("score", 1).alias("score"),
        F.array_sort(F.array_except("kinds", F.array("kind"))).alias("alias_kinds"), F.array_sort(F.array_distinct("all")).alias("sites"),
    )


def idioms(code: DataFrame) -> DataFrame:
    """``dump_id, addr, idiom``: raster wait, delay loop, copy loop, jump table, ROM call, music tick."""
    w = _order()
    s = _stream(code)
    cols = {f"{c}{i}": F.lead(c, i).over(w) for i in range(1, 8) for c in ("mnemonic", "op_str")}
    s = s.withColumns(cols | {"index1": F.lead("index", 1).over(w)})
    m = F.col("mnemonic")
    at = lambda i, *names: F.col(f"mnemonic{i}").isin(*names)
    indirect_jump = F.lit(False)
    for i in range(2, 8):
        indirect_jump = indirect_jump | (at(i, "jmp") & F.col(f"op_str{i}").startswith("("))
    rules = {
        "kernal_trampoline": m.isin("jmp", "jsr") & T.direct_target(F.col("op_str")).between(0xFF00, 0xFFFF),
        "raster_wait": (m == "lda") & F.col("dst").isin(*RASTER) & at(1, "cmp", "and", "bit") & at(2, "bne", "bcc", "bcs", "beq"),
        "delay_loop": m.isin("dex", "dey") & at(1, "bne") & (T.direct_target(F.col("op_str1")) <= F.col("addr")),
        "memcpy": (m == "lda") & (F.col("index") == "x") & at(1, "sta") & (F.col("index1") == "x") & at(2, "inx", "dex") & at(3, "bne"),
        "jump_table": (m == "asl") & at(1, "tax", "tay") & indirect_jump,
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(n)) for n, hit in rules.items()]))
    found = s.select("dump_id", "addr", F.explode(named).alias("idiom"))
    sid = _stream(code).where(F.col("mnemonic").isin(*isa.STORES) & F.col("dst").between(0xD400, 0xD418))
    fresh = F.coalesce(F.col("addr") - F.lag("addr").over(w) > 64, F.lit(True)).cast("int")
    sid = sid.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w))
    ticks = sid.groupBy("dump_id", "cluster").agg(F.min("addr").alias("addr"), F.count("*").alias("n")).where("n >= 3")
    return found.unionByName(ticks.select("dump_id", "addr", F.lit("sid_tick").alias("idiom")))


def score_loops(candidates: DataFrame, code: DataFrame, ram_under_kernal: Column | bool = False) -> DataFrame:
    """``dump_id, top, end, score`` and the counts behind it, of ``dump_id, top, end``.

    ``code`` has the instructions of a candidate's block in ``[top, end]``.  Candidates and
    code meet on pages of 256 addresses, then on the exact range.
    """
    code = code.select("dump_id", F.col("addr"), F.lower("mnemonic").alias("m"), T.direct_target(F.col("op_str")).alias("target"), T.operand_facts(F.col("op_str"))["addr"].alias("dst"), F.shiftright("addr", 8).alias("page"))
    pages = candidates.where("end - top >= 8").select("dump_id", "top", "end", F.explode(F.sequence(F.shiftright("top", 8), F.shiftright("end", 8))).alias("page"))
    inside = pages.join(code, ["dump_id", "page"]).where("addr between top and end")
    touched = F.coalesce("target", "dst")
    closes = ((F.col("m") == "jmp") | F.col("m").isin(*isa.BRANCHES)) & (F.col("target") == F.col("top"))
    stop = F.min(F.when(closes, F.struct("addr", "m"))).over(Window.partitionBy("dump_id", "top", "end"))
    inside = inside.withColumn("close", stop)
    before = F.col("close").isNull() | (F.col("addr") < F.col("close.addr"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = inside.groupBy("dump_id", "top", "end").agg(
        F.count("*").alias("n"), F.count_if(F.col("m") == "jsr").alias("calls"), F.count_distinct(F.when(F.col("m") == "jsr", F.col("target"))).alias("callees"),
        any_of(touched.isin(*RASTER)).alias("raster"), any_of(touched.isin(*INPUT)).alias("input"), any_of(touched.between(*VIC)).alias("vic"), any_of(touched.between(*SID)).alias("sid"),
        F.count_if(before & (F.col("m") == "jmp") & (F.col("target") >= F.col("top")) & (F.col("target") < F.col("addr"))).alias("back_jumps"), F.first("close.m", True).alias("close"),
    )
    span = F.col("end") - F.col("top")
    yes = lambda c, points: F.when(c, float(points)).otherwise(0.0)
    quiet = ~(F.col("raster") | F.col("input") | F.col("vic") | F.col("sid")) & (F.col("calls") == 0)
    score = (
        yes(span > 0x2000, -20) + F.when(F.col("calls") >= 8, 40.0).when(F.col("calls") >= 4, 20.0).when(F.col("calls") >= 2, 8.0).otherwise(0.0)
        + F.when(F.col("callees") >= 4, 12.0).when(F.col("callees") >= 2, 5.0).otherwise(0.0)
        + yes(F.col("raster"), 30) + yes(F.col("input"), 20) + yes(F.col("vic"), 10) + yes(F.col("sid"), 5)
        + F.col("back_jumps") * 10.0 + F.when(F.col("close") == "jmp", 25.0).when(F.col("close").isNotNull(), 12.0).otherwise(0.0)
        + yes((span <= 0x20) & quiet, -15) + F.when(F.col("top").between(0x0800, 0xCFFF), 10.0).when(F.col("top") >= 0xE000, F.when(F.lit(ram_under_kernal), 5.0).otherwise(-30.0)).otherwise(0.0)
    )
    return g.withColumn("score", score)


def loop_candidates(decoded: DataFrame, interrupts: DataFrame, boots: DataFrame, top_n: int = 8) -> DataFrame:
    """``dump_id, top, end, score, source`` ranked per image: backward jumps and branches, the RAM interrupt vector, the boot chain.

    ``decoded`` is an image's sequential code, ``interrupts``/``boots`` have ``dump_id, target``.
    The best score of an address stays, the earlier source on ties.
    """
    m = F.lower("mnemonic")
    back = decoded.withColumn("target", T.direct_target(F.col("op_str"))).where((m == "jmp") | m.isin(*isa.BRANCHES))
    back = back.where("target >= 2048 and target < addr and addr - target >= 8").where(F.col("addr") - F.col("target") <= F.when(m == "jmp", 0x2000).otherwise(0x0100))
    first = Window.partitionBy("dump_id", "target").orderBy("addr")
    back = back.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    jumps = back.select("dump_id", F.col("target").alias("top"), F.col("addr").alias("end"), F.lit(1).alias("rank"), F.when(m == "jmp", "backward_jmp").otherwise("backward_branch").alias("source"), F.lit(0.0).alias("bonus"))
    until = decoded.where(m.isin(*isa.RETURNS, *isa.JUMPS)).select("dump_id", F.col("addr").alias("stop"))
    irq = interrupts.where("target between 2048 and 53247").join(until, "dump_id").where("stop >= target and stop < target + 512").groupBy("dump_id", "target").agg(F.min("stop").alias("end"))
    irq = irq.select("dump_id", F.col("target").alias("top"), "end", F.lit(0).alias("rank"), F.lit("ram_irq_vector").alias("source"), F.lit(15.0).alias("bonus"))
    chain = boots.where("target between 2048 and 53247").withColumnRenamed("target", "boot").join(back.select("dump_id", "target", "addr"), "dump_id").where("addr >= boot and addr < boot + 6144")
    chain = chain.groupBy("dump_id", "boot").agg(F.min(F.struct("addr", "target")).alias("x"))
    chain = chain.select("dump_id", F.col("x.target").alias("top"), F.col("x.addr").alias("end"), F.lit(2).alias("rank"), F.lit("basic_sys_init_chain").alias("source"), F.lit(20.0).alias("bonus"))
    every = irq.unionByName(jumps).unionByName(chain)
    scored = every.join(score_loops(every.select("dump_id", "top", "end").distinct(), decoded), ["dump_id", "top", "end"])
    scored = scored.withColumn("score", F.round(F.col("score") + F.col("bonus"), 1)).where("score > 0 or rank <> 1")
    one = Window.partitionBy("dump_id", "top").orderBy(F.desc("score"), "rank")
    best = scored.withColumn("turn", F.row_number().over(one)).where("turn = 1")
    place = Window.partitionBy("dump_id").orderBy(F.desc("score"), "top")
    return best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top_n).select("dump_id", "place", "top", "end", "score", "source")


def screen_runs(byte_rows: DataFrame, base: int = 0x0400, columns: int = 40, rows: int = 25, least: int = 3) -> DataFrame:
    """``dump_id, addr, row, col, text``: runs of text on the screen; inner spaces stay."""
    cells = byte_rows.where(F.col("addr").between(base, base + columns * rows - 1))
    cells = cells.withColumns({"pos": F.col("addr") - base, "c": T.screen_char(F.col("b"))})
    cells = cells.withColumns({"row": F.floor(F.col("pos") / columns).cast("int"), "col": F.pmod("pos", F.lit(columns)).cast("int")})
    w = Window.partitionBy("dump_id", "row").orderBy("col")
    cells = cells.where("c is not null").withColumn("island", F.col("col") - F.row_number().over(w))
    text = cells.groupBy("dump_id", "row", "island").agg(F.array_sort(F.collect_list(F.struct("col", "c"))).alias("x"))
    text = text.withColumns({"all": F.array_join(F.transform("x", lambda v: v["c"]), ""), "begin": F.col("x")[0]["col"]})
    lead = F.length("all") - F.length(F.ltrim("all"))
    text = text.withColumns({"col": F.col("begin") + lead, "text": F.trim("all")}).where(F.length("text") >= least)
    return text.select("dump_id", (F.lit(base) + F.col("row") * columns + F.col("col")).cast("int").alias("addr"), "row", F.col("col").cast("int").alias("col"), "text")


def reduce_trace(trace: DataFrame) -> DataFrame:
    """First instruction per address, with the addresses it lies in and those that lie in it.

    ``trace``: ``trace_id, line_no, addr, n_bytes, mnemonic, operand``.
    """
    one = trace.groupBy("trace_id", "addr").agg(F.min_by(F.struct("line_no", "n_bytes", "mnemonic", "operand"), "line_no").alias("x")).select("trace_id", "addr", "x.*")
    cover = one.where("n_bytes > 1").select("trace_id", F.col("addr").alias("outer"), F.explode(F.sequence(F.col("addr") + 1, F.col("addr") + F.col("n_bytes") - 1)).alias("addr"))
    pairs = cover.join(one.select("trace_id", "addr"), ["trace_id", "addr"])
    inside = pairs.groupBy("trace_id", "addr").agg(F.array_sort(F.collect_set("outer")).alias("inside_of"))
    holds = pairs.groupBy("trace_id", F.col("outer").alias("addr")).agg(F.array_sort(F.collect_set(F.col("addr").alias("inner"))).alias("contains"))
    return one.join(inside, ["trace_id", "addr"], "left").join(holds, ["trace_id", "addr"], "left")


# Statements of the transliteration; {} is the operand.
STATEMENTS = {
    "lda": "A = {}", "ldx": "X = {}", "ldy": "Y = {}", "sta": "{} = A", "stx": "{} = X", "sty": "{} = Y", "tax": "X = A", "tay": "Y = A", "txa": "A = X",
    "tya": "A = Y", "txs": "SP = X", "tsx": "X = SP", "inc": "{}++", "dec": "{}--", "inx": "X++", "iny": "Y++", "dex": "X--", "dey": "Y--",
    "adc": "A += {} + carry", "sbc": "A -= {} + !carry", "and": "A &= {}", "ora": "A |= {}", "eor": "A ^= {}", "asl": "{} <<= 1", "lsr": "{} >>= 1",
    "rol": "{} = rol({})", "ror": "{} = ror({})", "cmp": "compare(A, {})", "cpx": "compare(X, {})", "cpy": "compare(Y, {})", "bit": "test(A, {})",
    "jmp": "goto {}", "jsr": "call {}", "rts": "return", "rti": "return_from_interrupt", "brk": "break", "nop": "nop", "pha": "push(A)", "pla": "A = pop()",
    "php": "push(flags)", "plp": "flags = pop()", "sec": "carry = 1", "clc": "carry = 0", "sei": "interrupts_off", "cli": "interrupts_on", "sed": "decimal = 1",
    "cld": "decimal = 0", "clv": "overflow = 0", "beq": "if equal goto {}", "bne": "if not equal goto {}", "bcs": "if carry goto {}", "bcc": "if not carry goto {}",
    "bmi": "if negative goto {}", "bpl": "if positive goto {}", "bvs": "if overflow goto {}", "bvc": "if not overflow goto {}",
}


def pseudocode(code: DataFrame) -> DataFrame:
    """``dump_id, addr, statement``; unknown mnemonics stay as ``asm(...)``."""
    dim = F.broadcast(code.sparkSession.createDataFrame(list(STATEMENTS.items()), "_m string, _s string"))  # a row per mnemonic
    s = code.join(dim, F.lower("mnemonic") == F.col("_m"), "left")
    op = F.when(F.coalesce("op_str", F.lit("")).isin("", "a"), "A").otherwise(F.regexp_replace("op_str", "0x", r"\$"))
    made = F.when(F.col("_s").isNull(), F.concat(F.lit("asm("), F.trim(F.concat_ws(" ", F.lower("mnemonic"), F.regexp_replace(F.coalesce("op_str", F.lit("")), "0x", r"\$"))), F.lit(")"))).otherwise(F.replace(F.col("_s"), F.lit("{}"), op))
    return s.select("dump_id", "addr", made.alias("statement"))


def writers_to(stops: DataFrame, byte_rows: DataFrame) -> DataFrame:
    """Stores that may have ended right before a watchpoint's stop.

    ``stops``: ``dump_id, pc, x, y, watched``.  Candidates are the two- and three-byte windows
    that end at ``pc``; the effective address must be the watched one, and a store that would
    overwrite itself is no candidate.
    """
    dim = isa.opcode_dim(byte_rows.sparkSession).where(F.col("mnemonic").isin(*isa.STORES, "inc", "dec", "asl", "lsr", "rol", "ror") & (F.col("size") > 1))
    cells = byte_rows.groupBy("dump_id").agg(F.map_from_entries(F.collect_list(F.struct("addr", "b"))).alias("mem"))  # 65,536 at most
    c = stops.join(cells, "dump_id").withColumn("size", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("site", F.col("pc") - F.col("size"))
    at = lambda a: F.coalesce(F.element_at("mem", a), F.lit(0))
    c = c.withColumns({"opcode": at(F.col("site")), "lo": at(F.col("site") + 1), "hi": F.when(F.col("size") == 3, at(F.col("site") + 2)).otherwise(0)})
    c = c.join(F.broadcast(dim), ["opcode", "size"])  # 151 rows at most
    base = T.word(F.col("lo"), F.col("hi"))
    pointer = lambda a: T.word(at(F.pmod(a, F.lit(256)).cast("int")), at(F.pmod(a + 1, F.lit(256)).cast("int")))
    wrap = lambda a, n: F.pmod(a, F.lit(n)).cast("int")
    effective = (
        F.when(F.col("mode").isin("abs", "zp"), base).when(F.col("mode") == "absx", wrap(base + F.col("x"), 0x10000)).when(F.col("mode") == "absy", wrap(base + F.col("y"), 0x10000))
        .when(F.col("mode") == "zpx", wrap(base + F.col("x"), 256)).when(F.col("mode") == "zpy", wrap(base + F.col("y"), 256))
        .when(F.col("mode") == "indy", wrap(pointer(F.col("lo")) + F.col("y"), 0x10000)).when(F.col("mode") == "indx", pointer(F.col("lo") + F.col("x")))
    )
    c = c.withColumn("effective", effective).where("effective = watched and not (effective between site and pc - 1)")
    own_pointer = (F.col("mode") == "indy") & ((F.col("watched") == F.col("lo")) | (F.col("watched") == wrap(F.col("lo") + 1, 256)))
    return c.where(~F.coalesce(own_pointer, F.lit(False))).select("dump_id", "pc", "watched", "site", "mnemonic", "mode")


def kinds_wanted(kinds: str, kind: str = "kind", aliases: str = "alias_kinds") -> Column:
    """Whether a finding's kind or one of its aliases is among pipe-separated ``kinds``; no kinds: any."""
    wanted = sorted({k.strip() for k in kinds.lower().split("|")} - {""})
    if not wanted:
        return F.lit(True)
    every = F.concat(F.array(F.col(kind)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return F.arrays_overlap(every, F.array(*[F.lit(k) for k in wanted]))


def gap_sessions(rows: DataFrame, keys: list[str], pos: str, gap: int = 64) -> DataFrame:
    """``begin, end, n`` of the runs of positions of a key that lie at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(pos)
    fresh = F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap).cast("int"), F.lit(0))
    runs = rows.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w))
    return runs.groupBy(*keys, "session").agg(F.min(pos).alias("begin"), F.max(pos).alias("end"), F.count("*").alias("n"))


def following(rows: DataFrame, keys: list[str], pos: str, what: str, n: int = 3) -> DataFrame:
    """Rows with the array ``gram`` of a value and the next ones in order; none where fewer follow."""
    w = Window.partitionBy(*keys).orderBy(pos)
    gram = F.array(F.col(what), *[F.lead(what, i).over(w) for i in range(1, n)])
    return rows.withColumn("gram", gram).where(F.element_at("gram", -1).isNotNull())

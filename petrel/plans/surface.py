"""The stores' modes by name: a catalog of views, a named plan per mode, and read-only SQL on analysed plans (§2.13).

A store is a mapping of view names to DataFrames.  ``KB`` and ``CODE`` list the modes; ``ask``
runs one.  Rows are plain tables: what a mode prints for a reader is left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.functions import text as T
from petrel.operators import graph, heuristics, layer0, retrieval
from petrel.plans import modes, sqlmode
from petrel.plans.sqlmode import Rejected

_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
#: Leaves that hold no data of their own, or rows that stand in the statement.
_BARE = ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef")


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def check_plan(spark: SparkSession, plan: JavaObject, views: Mapping[str, object]) -> None:
    """Raises unless an analysed plan, its subqueries included, is a query over the views and nothing else: no command, file, table or table function."""
    gateway, todo = spark.sparkContext._gateway, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if is_instance_of(gateway, node, _PLANS + "Command"):
            raise Rejected(f"only queries are allowed, not {name}")
        if name == "View":
            shown = node.desc().identifier().table()
            if not node.isTempView() or shown not in views:
                raise Rejected(f"no such view: {shown}")
            continue  # what a view is made of is its own matter
        below = list(_each(node.children()))
        if not below and name not in _BARE:
            raise Rejected(f"only the views can be read, not {node.nodeName()}")
        todo += below
        todo += list(_each(node.subqueries()))


def query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], store: str = "general", limit: int | None = None) -> tuple[DataFrame, int, str]:
    """(rows, count before the limit, statement that ran) of a read-only statement over the views.

    The guard's words are rejected first.  The statement is tried as it is, then with repaired
    names; what analysis makes of it decides, so commands nested in a query, files named as
    tables, catalog tables and table functions are rejected too.  The views last for this call.
    """
    text = sqlmode.dialect(sqlmode.guard(sql))
    names = sqlmode.GENERAL if store == "general" else sqlmode.CODE
    error: Exception | None = None
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        for candidate in dict.fromkeys((text, sqlmode.outside_literals(text, names))):
            try:
                if not sqlmode.is_query(spark, candidate):
                    raise Rejected("only queries are allowed")
                df = spark.sql(candidate)
            except PySparkException as e:
                error = error or e
                continue
            check_plan(spark, df._jdf.queryExecution().analyzed(), views)
            n = limit if limit is not None else sqlmode.LIMITS[store]
            shown = df.select(*[T.redact(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
            return shown.limit(max(1, n)), df.count(), candidate
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
    raise error


@dataclass(frozen=True)
class Mode:
    """A named plan: the views it needs and what it makes of them and the arguments."""

    needs: tuple[str, ...]
    plan: Callable[..., DataFrame]


def _limit(args: Mapping[str, object], default: int, most: int = 10_000) -> int:
    return modes.as_int(args.get("limit"), default, 1, most)


def _address(args: Mapping[str, object], *names: str) -> int:
    for name in names:
        if args.get(name) is not None:
            found = modes.seeds([args[name]])
            return found[0][0] if found else 0
    raise ValueError(f"needs one of: {', '.join(names)}")


def _stats(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """``view, n`` of every view, a row each."""
    counts = [df.agg(F.lit(name).alias("view"), F.count("*").alias("n")) for name, df in sorted(views.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _schema(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """``view, column, type``: no table is read."""
    spark = next(iter(views.values())).sparkSession
    return spark.createDataFrame([(name, c, t) for name, df in sorted(views.items()) for c, t in df.dtypes], "view string, column string, type string")


def _labels(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    return retrieval.relevant_labels(views["labels"], str(args.get("q") or ""), _limit(args, 50))


def _events(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """Newest events, of one kind if given; ties by id."""
    e = views["events"].where(F.col("kind") == args["kind"]) if args.get("kind") else views["events"]
    return e.orderBy(F.desc("ts"), F.desc("id")).limit(_limit(args, 50)).withColumn("payload_json", T.redact(F.col("payload_json")))


def _text(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    return retrieval.search_text(views["text_docs"], str(args["q"]), retrieval.clamp(_limit(args, 10), 50))


def _semantic(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """Hybrid ranking against a vector that the caller has: embedding texts is a model's work."""
    return retrieval.hybrid_rerank(views["vectors"], args["vector"], list(args.get("terms") or ()), _limit(args, 8))


def _holding(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """The routine that starts at an address, else the smallest that holds it; one row at most."""
    at = _address(args, "start", "addr", "address")
    r = views["code_routines"].where(F.lit(at).between(F.col("start_addr"), F.col("end_addr")))
    return r.orderBy(F.desc(F.col("start_addr") == at), F.col("end_addr") - F.col("start_addr"), "start_addr").limit(1)


def _routines(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """By callers, as ``graph.rank_routines``."""
    r = views["code_routines"].select(F.col("start_addr").alias("start"), F.col("end_addr").alias("end"), "name")
    e = views["code_xrefs"].select(F.col("src_addr").alias("src"), F.col("dst_addr").alias("dst"), F.col("kind").alias("edge"))
    h = views["hypotheses"].where("layer = 1").select(F.col("annotation_id").alias("id"), F.col("start_addr").alias("start"), F.col("name_suggestion").alias("name"), "confidence")
    return graph.rank_routines(r, e, h).limit(_limit(args, 50))


def _listing(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    span = F.broadcast(_holding(views, args).select("start_addr", "end_addr"))  # one row
    return views["instructions"].join(span, F.col("addr").between(F.col("start_addr"), F.col("end_addr"))).drop("start_addr", "end_addr").orderBy("addr")


def _pseudocode(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    code = _listing(views, args).select(F.lit("code").alias("dump_id"), "addr", "mnemonic", F.col("operand").alias("op_str"))
    return heuristics.pseudocode(code).drop("dump_id").orderBy("addr")


def _xrefs_to(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    hit = views["code_xrefs"].where(F.col("dst_addr") == _address(args, "addr", "target"))
    return hit.select("src_addr", "kind").distinct().orderBy("src_addr", "kind").limit(_limit(args, 100))


def _xrefs_from(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    start = _address(args, "start", "addr")
    end = _address(args, "end") if args.get("end") is not None else start
    hit = views["code_xrefs"].where(F.col("src_addr").between(start, end))
    return hit.select("src_addr", "dst_addr", "kind").distinct().orderBy("src_addr", "dst_addr", "kind").limit(_limit(args, 200))


def _smc(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    return views["code_smc_sites"].orderBy("src_addr", "dst_addr").limit(_limit(args, 100))


def _data(writes: bool, default: int) -> Callable[[Mapping[str, DataFrame], Mapping[str, object]], DataFrame]:
    def plan(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
        hit = views["code_data_refs"].where(F.col("dst_addr") == _address(args, "addr", "target"))
        hit = hit.where(F.col("access").isin("w", "rmw")) if writes else hit
        return hit.select("src_addr", "access", "index_reg", "indirect").distinct().orderBy("src_addr", "access", "index_reg", "indirect").limit(_limit(args, default))

    return plan


def _hardware_refs(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    start = _address(args, "start", "addr") if args.get("start") is not None or args.get("addr") is not None else 0xD000
    end = _address(args, "end") if args.get("end") is not None else 0xDFFF
    hit = views["code_data_refs"].where(F.col("dst_addr").between(start, end))
    return hit.select("src_addr", "dst_addr", "access", "index_reg").distinct().orderBy("dst_addr", "src_addr", "access", "index_reg").limit(_limit(args, 300))


def _hardware(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """The register at one address."""
    spark = next(iter(views.values())).sparkSession
    return layer0.hardware(spark.createDataFrame([(_address(args, "addr", "address"),)], "addr int"))


def _groups(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """Layer-2 hypotheses, surest first (T4)."""
    h = views["hypotheses"].where("layer = 2").select("annotation_id", "start_addr", "end_addr", "text", "name_suggestion", "confidence", "producer", "flags_json")
    return h.orderBy(F.desc("confidence"), "start_addr", "annotation_id").limit(retrieval.clamp(_limit(args, 50), 200))


def _critiques(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """Layer-3 critiques, newest first; a payload that is no JSON object leaves its fields null (T4)."""
    a = views["annotations"].where("layer = 3 and kind = 'critique'").orderBy(F.desc("seq")).limit(retrieval.clamp(_limit(args, 50), 200))
    fields = F.from_json("payload_json", "verdict string, summary string, target string", {"mode": "PERMISSIVE"})
    return a.withColumn("p", fields).select("id", "start_addr", "end_addr", "producer", "confidence", "evidence_json", "flags_json", "seq", "p.*")


def _search(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """``path, match_at, snippet``: listings that contain the text, by path; 200 characters before the match and 800 from it on."""
    q = str(args.get("q") or args.get("query") or "").strip().lower()
    if not q:
        raise ValueError("needs q")
    at = F.instr(F.lower("content"), q) - 1
    rows = views["asm_docs"].withColumn("match_at", at).where("match_at >= 0").orderBy("path").limit(_limit(args, 10))
    begin, end = F.greatest(F.col("match_at") - 200, F.lit(0)), F.col("match_at") + 800
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(F.col("content"), begin + 1, end - begin), F.when(end < F.length("content"), "...").otherwise(""))
    return rows.select("path", "match_at", T.redact(cut).alias("snippet"))


def _disasm(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """Instructions of the view from an address on, up to the count."""
    return views["instructions"].where(F.col("addr") >= _address(args, "start", "addr", "address")).orderBy("addr").limit(modes.as_int(args.get("count"), 32, 1, 600))


def _export(views: Mapping[str, DataFrame], args: Mapping[str, object]) -> DataFrame:
    """The listing of all instructions with names in place of targets, by address."""
    names = views["code_labels"].groupBy("addr").agg(F.min("name").alias("name"))
    to = T.direct_target(F.col("operand"))
    code = views["instructions"].withColumn("to", to).join(names.select(F.col("addr").alias("to"), F.col("name").alias("shown")), "to", "left").join(names, "addr", "left")
    line = F.rtrim(F.concat(T.hex_label(F.col("addr")), F.lit("  "), F.upper("mnemonic"), F.lit(" "), F.coalesce("shown", "operand")))
    return code.select("addr", F.when(F.col("name").isNotNull(), F.concat("name", F.lit(":"))).alias("label"), line.alias("line")).orderBy("addr")


KB: dict[str, Mode] = {
    "stats": Mode((), _stats), "schema": Mode((), _schema), "labels": Mode(("labels",), _labels), "events": Mode(("events",), _events),
    "text": Mode(("text_docs",), _text), "text_semantic": Mode(("vectors",), _semantic),
}
CODE: dict[str, Mode] = {
    "stats": Mode((), _stats), "schema": Mode((), _schema), "hardware": Mode((), _hardware), "routines": Mode(("code_routines", "code_xrefs", "hypotheses"), _routines),
    "routine": Mode(("code_routines",), _holding), "pseudocode": Mode(("code_routines", "instructions"), _pseudocode), "xrefs_to": Mode(("code_xrefs",), _xrefs_to),
    "xrefs_from": Mode(("code_xrefs",), _xrefs_from), "smc": Mode(("code_smc_sites",), _smc), "writes_to": Mode(("code_data_refs",), _data(True, 100)),
    "refs_to": Mode(("code_data_refs",), _data(False, 200)), "hardware_refs": Mode(("code_data_refs",), _hardware_refs), "groups": Mode(("hypotheses",), _groups),
    "critiques": Mode(("annotations",), _critiques), "search": Mode(("asm_docs",), _search), "disasm": Mode(("instructions",), _disasm),
    "export": Mode(("instructions", "code_labels"), _export),
}


def ask(store: str, mode: str, views: Mapping[str, DataFrame], **args: object) -> DataFrame:
    """Rows of a mode of ``kb`` or ``code_kb``; ``sql`` takes ``sql`` and ``limit``.

    An unknown mode, a missing view or a bad argument is an error that says so.
    """
    table = {"kb": KB, "code_kb": CODE}[store]
    if mode == "sql":
        spark = next(iter(views.values())).sparkSession
        return query(spark, str(args["sql"]), views, "general" if store == "kb" else "code", _limit(args, sqlmode.LIMITS["general" if store == "kb" else "code"]))[0]
    if mode not in table:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join([*table, 'sql'])}")
    if missing := [v for v in table[mode].needs if v not in views]:
        raise ValueError(f"{mode} needs the views {', '.join(missing)}")
    return table[mode].plan(views, args)

"""Queries over call and jump edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import count_callers, routine_edges, smallest_containing

#: Edges that neighbourhoods follow.
CALL_EDGES = ("jsr", "jmp", "jmp_indirect")


def neighbourhood(routines: DataFrame, edges: DataFrame, start: int, hops: int = 2, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """Nodes ``addr, hop, name, stub`` within so many hops of a routine, and the edges among them.

    Edges run both ways.  Targets in no routine are stubs and are not followed.  The cap takes
    nodes by hop, then address.  Every round is a join of the frontier (bounded by the cap)
    with the edges; rounds are the hops, so the plan is bounded as well.
    """
    r = routines.select("start", "end", "name")
    e = edges.where(F.col("edge").isin(*CALL_EDGES)).select("src", "dst").distinct()
    a = smallest_containing(e, r.select("start", "end"), "src", (), False).withColumnRenamed("start", "a").drop("end")
    b = smallest_containing(a, r.select("start", "end"), "dst", (), False)
    node_edges = b.select(F.coalesce("a", "src").alias("a"), F.col("a").isNull().alias("a_stub"), F.coalesce("start", "dst").alias("b"), F.col("start").isNull().alias("b_stub")).where("a <> b").distinct()
    both = node_edges.unionByName(node_edges.select(F.col("b").alias("a"), F.col("b_stub").alias("a_stub"), F.col("a").alias("b"), F.col("a_stub").alias("b_stub")))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0, False)], "addr int, hop int, stub boolean")
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.where("not stub").join(both, F.col("addr") == F.col("a")).select(F.col("b").alias("addr"), F.lit(hop).alias("hop"), F.col("b_stub").alias("stub")).distinct()
        frontier = step.join(seen.select("addr"), "addr", "left_anti").select("addr", "hop", "stub").orderBy("addr").limit(most)
        seen = seen.unionByName(frontier).orderBy("hop", "addr").limit(most)
    nodes = seen.join(r.select(F.col("start").alias("addr"), "name"), "addr", "left")
    ids = seen.select("addr")
    inside = node_edges.join(ids.withColumnRenamed("addr", "a"), "a", "left_semi").join(ids.withColumnRenamed("addr", "b"), "b", "left_semi")
    return nodes, inside.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def induced(routines: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges between selected routines (``start``), distinct, none to itself."""
    chosen = routines.join(selected.select("start"), "start", "left_semi")
    return routine_edges(chosen, edges)


def xrefs_to(edges: DataFrame, target: int, limit: int = 100) -> DataFrame:
    """N3."""
    return edges.where(F.col("dst") == target).select("src", "dst", "edge").distinct().orderBy("src", "edge").limit(limit)


def xrefs_from(edges: DataFrame, start: int, end: int, limit: int = 200) -> DataFrame:
    return edges.where(F.col("src").between(start, end)).select("src", "dst", "edge").distinct().orderBy("src", "dst", "edge").limit(limit)


def writes_to(refs: DataFrame, target: int, limit: int = 100) -> DataFrame:
    return refs.where((F.col("dst") == target) & F.col("access").isin("w", "rmw")).select("src", "dst", "access", "index").distinct().orderBy("src", "access", "index").limit(limit)


def refs_to(refs: DataFrame, target: int, access: str | None = None, limit: int = 200) -> DataFrame:
    hit = refs.where(F.col("dst") == target)
    hit = hit.where(F.col("access") == access) if access else hit
    return hit.select("src", "dst", "access", "index").distinct().orderBy("src", "access", "index").limit(limit)


def hardware_refs(refs: DataFrame, start: int, end: int, limit: int = 300) -> DataFrame:
    return refs.where(F.col("dst").between(start, end)).select("src", "dst", "access").distinct().orderBy("dst", "src", "access").limit(limit)


def best_hypothesis(hypotheses: DataFrame) -> DataFrame:
    """Best row per routine start: highest confidence, then highest id (W1, N4). An aggregate, so a hot start is no hot task."""
    rest = [c for c in hypotheses.columns if c != "start"]
    best = hypotheses.groupBy("start").agg(F.max_by(F.struct(*rest), F.struct("confidence", "id")).alias("_x"))
    return best.select("start", "_x.*").select(*hypotheses.columns)


def rank_routines(routines: DataFrame, edges: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``start, end, display_name, callers, confidence`` by callers, then address.

    A hypothesis's name stands in where the routine's own is a placeholder; the pattern
    ``sub_%`` treats its underscore as any character, as the query it mirrors does.
    """
    counted = count_callers(routines, edges)
    best = best_hypothesis(hypotheses).select("start", F.col("name").alias("hyp_name"), F.col("confidence"))
    j = counted.join(best, "start", "left")
    own = F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").like("sub_%")
    name = F.when(own, F.col("name")).otherwise(F.coalesce("hyp_name", "name"))
    return j.select("start", "end", name.alias("display_name"), "callers", "confidence").orderBy(F.desc("callers"), "start")


def routine_window(code: DataFrame, routines: DataFrame, edges: DataFrame, refs: DataFrame, focus: int, lines: int = 240) -> dict[str, DataFrame]:
    """Listing centred on the focus, callers, callees and hardware hits of its routine."""
    point = code.sparkSession.createDataFrame([(focus,)], "addr int")
    own = smallest_containing(point, routines.select("start", "end", "name"))  # one row
    span = F.broadcast(own.select("start", "end"))  # one row
    inside = code.join(span, F.col("addr").between(F.col("start"), F.col("end")))
    near = inside.withColumn("_r", F.row_number().over(Window.orderBy(F.abs(F.col("addr") - focus), "addr"))).where(F.col("_r") <= lines)  # one routine's rows
    callers = edges.join(span, F.col("dst").between(F.col("start"), F.col("end"))).where("not (src between start and end)").select("src", "dst", "edge").distinct()
    callees = edges.join(span, F.col("src").between(F.col("start"), F.col("end"))).where("not (dst between start and end)").select("src", "dst", "edge").distinct()
    hits = refs.join(span, F.col("src").between(F.col("start"), F.col("end"))).where("dst between 53248 and 57343").select("dst", "access").distinct()
    return {"routine": own, "listing": near.drop("_r", "start", "end").orderBy("addr"), "callers": callers, "callees": callees, "hardware": hits}


def validate_plan(steps: DataFrame) -> DataFrame:
    """``problem, step_id, detail``: repeated ids, unknown dependencies, steps on a cycle.

    ``steps``: ``plan_id, step_id, depends_on``.  Steps without open dependencies are taken away
    again and again; what is left after as many rounds as a plan has steps lies on, or behind,
    a cycle.  Plans have a dozen steps at most, so rounds are bounded by that.
    """
    twice = steps.groupBy("plan_id", "step_id").count().where("count > 1").select("plan_id", F.lit("duplicate_id").alias("problem"), "step_id", F.lit(None).cast("string").alias("detail"))
    deps = steps.select("plan_id", "step_id", F.explode("depends_on").alias("dep"))
    known = steps.select("plan_id", F.col("step_id").alias("dep")).distinct()
    unknown = deps.join(known, ["plan_id", "dep"], "left_anti").select("plan_id", F.lit("unknown_dependency").alias("problem"), "step_id", F.col("dep").alias("detail"))

    def reduce_plan(rows):
        import pandas as pd

        left = {r.step_id: set(r.depends_on) for r in rows.itertuples()}
        while free := [s for s, d in left.items() if not d & left.keys()]:
            for s in free:
                del left[s]
        return pd.DataFrame([(rows["plan_id"].iloc[0], "cycle", s, None) for s in sorted(left)], columns=["plan_id", "problem", "step_id", "detail"])

    cycles = steps.groupBy("plan_id").applyInPandas(reduce_plan, twice.schema)
    return twice.unionByName(unknown).unionByName(cycles)

"""Plans, results, budgets and usage as tables.

``steps``: ``plan_id, step_id, pos, tool, args, depends_on``; ``results``: ``plan_id, step_id,
result_pos, ok, retryable, rejection, outcome``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS, FAN_OUT, PAYLOADS = 2, 4, 96
# Tools that only read, and rejections that no retry cures.
READ_ONLY = ("kb", "code_kb", "disasm", "memdiff", "text_search")
PERMANENT = ("invalid_args", "unknown_tool")


def permanent(retryable: Column, rejection: Column) -> Column:
    """Z20."""
    return F.coalesce(retryable == False, F.lit(False)) | F.coalesce(rejection.isin(*PERMANENT), F.lit(False))  # noqa: E712


def step_status(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Every step with ``fails, succeeded, inconclusive, exhausted, pending``.

    A success both clears an earlier and bars a later inconclusive, so a step is inconclusive
    if some result says so and none succeeded.
    """
    r = results.groupBy("plan_id", "step_id").agg(
        F.bool_or(F.coalesce("ok", F.lit(False)) & (F.coalesce("outcome", F.lit("")) != "inconclusive")).alias("_s"), F.bool_or(F.coalesce("outcome", F.lit("")) == "inconclusive").alias("_i"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("fails"), F.bool_or(~F.coalesce("ok", F.lit(False)) & permanent(F.col("retryable"), F.col("rejection"))).alias("_p"),
    )
    j = steps.join(r, ["plan_id", "step_id"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    j = j.withColumns({"fails": F.coalesce("fails", F.lit(0).cast("long")), "succeeded": yes(F.col("_s")), "inconclusive": yes(F.col("_i")) & ~yes(F.col("_s"))})
    j = j.withColumn("exhausted", ~F.col("succeeded") & ((F.col("fails") >= ATTEMPTS) | yes(F.col("_p"))))
    return j.withColumn("pending", ~F.col("succeeded") & ~F.col("inconclusive") & ~F.col("exhausted")).drop("_s", "_i", "_p")


def dependency_status(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Per step and dependency the dependency's state: satisfied, missing, exhausted, inconclusive or pending (L3)."""
    status = step_status(steps, results)
    dep = status.select("plan_id", F.col("step_id").alias("dep"), "succeeded", "inconclusive", "exhausted", F.lit(True).alias("known"))
    d = steps.select("plan_id", "step_id", F.explode("depends_on").alias("dep")).join(dep, ["plan_id", "dep"], "left")
    state = F.when(F.col("known").isNull(), "missing").when(F.col("succeeded"), "satisfied").when(F.col("exhausted"), "exhausted").when(F.col("inconclusive"), "inconclusive").otherwise("pending")
    return d.select("plan_id", "step_id", "dep", state.alias("state"))


def runnable(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Pending steps whose dependencies all succeeded, untried first (L1)."""
    unmet = dependency_status(steps, results).where("state <> 'satisfied'").select("plan_id", "step_id").distinct()
    ready = step_status(steps, results).where("pending").join(unmet, ["plan_id", "step_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("fails", "pos"))
    return ready.withColumn("turn", place)


def fan_out(steps: DataFrame, results: DataFrame, read_only: Sequence[str] = READ_ONLY, most: int = FAN_OUT) -> DataFrame:
    """The first fresh, concrete, read-only steps that may run together; none if there are fewer than two (L2)."""
    fresh = runnable(steps, results).where((F.col("fails") == 0) & F.col("tool").isin(*read_only) & F.col("args").isNotNull() & ~F.coalesce(F.col("args"), F.lit("")).contains("{{"))
    w = Window.partitionBy("plan_id")
    ranked = fresh.withColumns({"_n": F.row_number().over(w.orderBy("turn")), "_all": F.count("*").over(w)})
    return ranked.where((F.col("_n") <= most) & (F.col("_all") >= 2)).drop("_n", "_all")


def blocked(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Pending steps that can't run, with the reason per unmet dependency (L3)."""
    pending = step_status(steps, results).where("pending").select("plan_id", "step_id")
    d = dependency_status(steps, results).where("state <> 'satisfied'").join(pending, ["plan_id", "step_id"], "left_semi")
    return d.select("plan_id", "step_id", "dep", F.concat(F.lit("dependency "), "dep", F.lit(" is "), "state").alias("reason"))


def failed_notes(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Exhausted or inconclusive steps of the current plan with their last failure."""
    bad = step_status(steps, results).where("exhausted or inconclusive").select("plan_id", "step_id")
    last = results.where("not coalesce(ok, false) or outcome = 'inconclusive'").groupBy("plan_id", "step_id").agg(F.max_by(F.coalesce("outcome", "rejection", F.lit("failed")), "result_pos").alias("note"))
    return bad.join(last, ["plan_id", "step_id"], "left")


def result_identity(results: DataFrame) -> DataFrame:
    """``result_id``: 20 digits of a hash of the content, with _2, _3 for repeats (L4, X11)."""
    h = F.substring(F.sha2(F.concat_ws("\u0001", "step_id", "tool", "data").cast("binary"), 256), 1, 20)
    n = F.row_number().over(Window.partitionBy("_h").orderBy("result_pos"))
    return results.withColumn("_h", h).withColumn("_n", n).withColumn("result_id", F.concat("_h", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""))).drop("_h", "_n")


def bound_payloads(results: DataFrame, keys: Sequence[str] = ("run_id",), most: int = PAYLOADS) -> DataFrame:
    """Status of every result stays; data only of the newest bulky ones."""
    bulky = F.col("data").isNotNull()
    place = F.row_number().over(Window.partitionBy(*keys, bulky).orderBy(F.desc("result_pos")))
    return results.withColumn("data", F.when(bulky & (place <= most), F.col("data")))


def rehydrate(results: DataFrame, events: DataFrame) -> DataFrame:
    """Payloads that the ledger dropped, read again by event id."""
    log = events.select("event_id", F.col("data").alias("_data"))
    return results.join(log, "event_id", "left").withColumn("data", F.coalesce("data", "_data")).drop("_data")


def termination(state: DataFrame) -> DataFrame:
    """``decision`` by the first limit that holds: reservation, dollars, tokens, iterations, dead end, verdict."""
    d = (
        F.when(F.col("cost_usd") + F.col("reserved_usd") > F.col("max_usd"), "stop_reservation").when(F.col("cost_usd") >= F.col("max_usd"), "stop_budget")
        .when(F.col("tokens") >= F.col("max_tokens"), "stop_tokens").when(F.col("iterations") >= F.col("max_iterations"), "stop_iterations")
        .when(F.col("dead_end"), "stop_dead_end").when(F.col("verdict") == "accept", "finish").when(F.col("verdict") == "revise", "revise").otherwise("replan")
    )
    return state.withColumn("decision", d)


def two_replans(verdicts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Runs whose last two verdicts are both replan."""
    w = Window.partitionBy(*keys).orderBy("pos")
    last = verdicts.withColumns({"before": F.lag("decision").over(w), "_n": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))})
    return last.where("_n = 1").select(*keys, ((F.col("decision") == "replan") & F.coalesce(F.col("before") == "replan", F.lit(False))).alias("dead_end"))


def normalise_plan(steps: DataFrame, prefix: str = "s") -> DataFrame:
    """Ids with a prefix, repeats with a suffix, dependencies on the first of the name."""
    base = F.when(F.col("step_id").startswith(prefix), F.col("step_id")).otherwise(F.concat(F.lit(prefix), F.col("step_id").cast("string")))
    n = F.row_number().over(Window.partitionBy("plan_id", "_b").orderBy("pos"))
    s = steps.withColumn("_b", base).withColumn("_n", n)
    depends = F.transform("depends_on", lambda d: F.when(d.startswith(prefix), d).otherwise(F.concat(F.lit(prefix), d)))
    return s.withColumns({"step_id": F.concat("_b", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise("")), "depends_on": depends}).drop("_b", "_n")


def guard_verdicts(reviews: DataFrame) -> DataFrame:
    """Accept or revise with blocking steps is a replan; high confidence without evidence a revision; a third revision an acceptance."""
    v = F.col("verdict")
    d = (
        F.when(v.isin("accept", "revise") & (F.col("blocking_steps") > 0), "replan").when((v == "accept") & (F.col("confidence") >= 0.85) & (F.col("evidence_count") == 0) & (F.col("revisions") < 2), "revise")
        .when((v == "revise") & (F.col("revisions") >= 2), "accept").otherwise(v)
    )
    return reviews.withColumn("decision", d)


def truncated_runs(runs: DataFrame, cap: float = 0.4, note: str = "run was cut short") -> DataFrame:
    """Cut runs: confidence capped, note added once, verdict rewritten."""
    cut = F.col("truncated")
    noted = F.when(F.coalesce("notes", F.lit("")).contains(note), F.col("notes")).otherwise(F.concat_ws("; ", "notes", F.lit(note)))
    return runs.withColumns({"confidence": F.when(cut, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")), "notes": F.when(cut, noted).otherwise(F.col("notes")), "verdict": F.when(cut & (F.col("verdict") == "accept"), "truncated").otherwise(F.col("verdict"))})


def price_calls(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from the longest model prefix that has a price.

    ``prices``: ``prefix, usd_in, usd_out`` per million tokens, a row per model family.  All
    prefixes of a model name that are as long as some price's are made and joined by equality.
    """
    lengths = prices.select(F.length("prefix").alias("n")).distinct().agg(F.collect_set("n").alias("lens"))  # one row, bounded by the longest name
    models = usage.select("model").distinct().join(F.broadcast(lengths), F.lit(True), "left")
    tried = models.select("model", F.explode("lens").alias("n")).where(F.length("model") >= F.col("n")).select("model", F.substring(F.col("model"), F.lit(1), F.col("n")).alias("prefix"))
    best = tried.join(prices, "prefix").groupBy("model").agg(F.max_by(F.struct("prefix", "usd_in", "usd_out"), F.length("prefix")).alias("p"))
    j = usage.join(best, "model", "left")
    cost = (F.col("input_tokens") * F.col("p.usd_in") + F.col("output_tokens") * F.col("p.usd_out")) / 1e6
    return j.select(*usage.columns, F.col("p.prefix").alias("price_prefix"), F.coalesce(cost, F.lit(0.0)).alias("cost_usd"))


def usage_by_role(usage: DataFrame) -> DataFrame:
    """Calls, failures, stand-ins, tokens and cost per role and model."""
    return usage.groupBy("role", "model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("as_role").isNotNull() & (F.col("as_role") != F.col("role"))).alias("backups"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
    ).orderBy(F.desc("cost_usd"), F.desc("calls"), "role", "model")


def merge_counters(counters: DataFrame) -> DataFrame:
    """Tool call counters, added up; any grouping of additions gives the same."""
    return counters.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("failures").alias("failures"))


def running_spend(calls: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Cost and tokens so far, and whether the next call's reservation still fits."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = calls.withColumns({"spent": F.sum("cost_usd").over(w), "tokens": F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w)})
    return c.withColumn("fits", F.col("spent") + F.col("reserve_usd") <= F.col("max_usd"))


def mutating(calls: DataFrame, read_methods: DataFrame) -> DataFrame:
    """Calls of methods not known to read count as mutating; a read of the stopwatch is exempt."""
    j = calls.join(read_methods.select("method", F.lit(True).alias("_r")), "method", "left")
    return j.withColumn("mutating", ~(F.coalesce("_r", F.lit(False)) | ((F.col("method") == "stopwatch") & (F.coalesce(F.col("action"), F.lit("")) == "read")))).drop("_r")


def trace_outcomes(traces: DataFrame) -> DataFrame:
    """confirmed, inconclusive or error, by what went wrong first."""
    o = F.when(F.col("trace_id").isNull(), "error").when(F.col("run_error").isNotNull(), "error").when(F.col("hits") > 0, "confirmed").when(F.col("poll_errors") > 0, "error").otherwise("inconclusive")
    return traces.withColumn("outcome", o)


def clean_annotations(ann: DataFrame) -> DataFrame:
    """Model output made regular: confidence in [0, 1], empty idiom as null, lists where lists belong, motivation appended."""
    none = F.array().cast("array<string>")
    text = F.when(F.coalesce("motivation", F.lit("")) != "", F.concat_ws("\n", "summary", F.concat(F.lit("Motivation: "), "motivation"))).otherwise(F.col("summary"))
    return ann.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))), "idiom": F.when(F.lower(F.trim("idiom")).isin("", "none", "null"), None).otherwise(F.col("idiom")), "evidence": F.coalesce("evidence", none), "summary": text})


def evaluate_golden(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Missing addresses and keywords, confidence floor and pass per case.

    ``cases``: ``id, expected_addresses, expected_keywords, min_confidence``; ``answers``: ``id, text, confidence, addresses``.
    """
    j = cases.join(answers, "id", "left")
    low = F.lower(F.coalesce("text", F.lit("")))
    addresses = F.array_except("expected_addresses", F.coalesce("addresses", F.array().cast("array<int>")))
    words = F.filter("expected_keywords", lambda k: ~F.call_function("rlike", low, F.concat(F.lit(r"(?<![a-z0-9_])"), F.regexp_replace(F.lower(k), r"([.\[\]{}()*+?^$|\\-])", r"\\$1"), F.lit(r"(?![a-z0-9_])"))))
    floor = F.coalesce(F.col("confidence") >= F.col("min_confidence"), F.lit(False))
    return j.select("id", addresses.alias("missing_addresses"), words.alias("missing_keywords"), floor.alias("confident"), (floor & (F.size(addresses) == 0) & (F.size(words) == 0)).alias("passed"))


def latest_ratings(turns: DataFrame, ratings: DataFrame) -> DataFrame:
    """Turns with their latest rating."""
    last = ratings.groupBy("run_id").agg(F.max_by(F.struct("rating", "comment"), "revision").alias("_r")).select("run_id", "_r.*")
    return turns.join(last, "run_id")

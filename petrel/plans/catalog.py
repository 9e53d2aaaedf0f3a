"""More registered queries: scalar functions, ledger rules, folds and lookups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrel.functions import text as T
from petrel.operators import fold, heuristics, intervals, ledger, retrieval
from petrel.plans import modes
from petrel.plans.registry import _EDGES, _LOG, _ROUTINES, _edges, _log, _register, _routines, _t

_WRITTEN = """CASE p_partkey % 6 WHEN 0 THEN '$' || printf('%X', p_partkey % 65536) WHEN 1 THEN '0x' || printf('%04x', p_partkey % 65536) WHEN 2 THEN CAST(p_partkey * 7 AS VARCHAR)
 WHEN 3 THEN ' ' || printf('%04X', p_partkey % 65536) WHEN 4 THEN 'x' || CAST(p_partkey AS VARCHAR) ELSE '$1' || printf('%04X', p_partkey % 65536) END"""


def _written(spark, d):
    k = F.col("p_partkey")
    four = F.lpad(F.hex(k % 65536), 4, "0")
    s = F.when(k % 6 == 0, F.concat(F.lit("$"), F.hex(k % 65536))).when(k % 6 == 1, F.concat(F.lit("0x"), F.lower(four))).when(k % 6 == 2, (k * 7).cast("string"))
    s = s.when(k % 6 == 3, F.concat(F.lit(" "), four)).when(k % 6 == 4, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("$1"), four))
    return _t(spark, d, "part").select("p_partkey", s.alias("s"))


@_register(rf"""WITH w AS (SELECT p_partkey, {_WRITTEN} AS s FROM part), x AS (SELECT p_partkey, regexp_extract(trim(s), '^(?:\$|0[xX])?([0-9A-Fa-f]{{1,4}})$', 1) AS h FROM w)
SELECT p_partkey, CASE WHEN h <> '' THEN CAST('0x' || h AS INT) END AS addr FROM x""")
def strict_address(spark, d):
    return _written(spark, d).select("p_partkey", T.parse_address(F.col("s")).alias("addr"))


@_register(rf"""WITH w AS (SELECT p_partkey, trim({_WRITTEN}) AS s FROM part)
SELECT p_partkey, CAST(CASE WHEN regexp_matches(s, '^(\$|0[xX])[0-9A-Fa-f]{{1,8}}$') THEN CAST('0x' || regexp_replace(s, '^(\$|0[xX])', '') AS BIGINT) WHEN regexp_matches(s, '^[0-9]{{1,9}}$') THEN CAST(s AS BIGINT)
 WHEN regexp_matches(s, '^[0-9A-Fa-f]{{1,8}}$') THEN CAST('0x' || s AS BIGINT) END % 65536 AS INT) AS addr FROM w""")
def lenient_address(spark, d):
    return _written(spark, d).select("p_partkey", T.parse_address_lenient(F.col("s")).alias("addr"))


@_register("""SELECT p_partkey, '$' || printf('%04X', p_partkey % 65536) AS label, CAST(p_partkey % 256 + (p_size % 256) * 256 AS INT) AS word,
CAST((p_size - p_partkey % 256 + 128 + 512) % 256 - 128 AS INT) AS delta FROM part""")
def byte_words(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", T.hex_label(k % 65536).alias("label"), T.word(k % 256, F.col("p_size") % 256).alias("word"), T.signed_delta(F.col("p_size"), k % 256).alias("delta"))


@_register(r"""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12) AS slug,
substr(CASE WHEN regexp_matches(regexp_replace(trim(p_brand), '[^A-Za-z0-9_]', '_', 'g'), '^[0-9]') THEN '_' ELSE '' END || regexp_replace(trim(p_brand), '[^A-Za-z0-9_]', '_', 'g'), 1, 64) AS identifier FROM part""")
def names_normalised(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.slug(F.col("p_name"), 12).alias("slug"), T.identifier(F.col("p_brand")).alias("identifier"))


@_register("SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…[truncated]' ELSE text END AS clipped, substr(sha256(text), 1, 20) AS identity FROM conversations")
def clipped_turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.clip(F.col("text"), 60).alias("clipped"), T.identity(F.col("text"), 20).alias("identity"))


@_register("""SELECT event_id, CAST(greatest(0, date_diff('second', ts, TIMESTAMP '2024-01-15 00:00:00')) AS DOUBLE) AS elapsed FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def elapsed_since(spark, d):
    written = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    return _t(spark, d, "events").select("event_id", T.elapsed_seconds(T.parse_time(written), T.parse_time(F.lit("2024-01-15T00:00:00Z"))).alias("elapsed"))


@_register("""SELECT o_orderkey, CASE WHEN o_totalprice / 1000 + 50 > 400 THEN 'stop_reservation' WHEN o_totalprice / 1000 >= 400 THEN 'stop_budget' WHEN o_orderkey % 97 * 40000 >= 3000000 THEN 'stop_tokens'
WHEN o_orderkey % 17 >= 12 THEN 'stop_iterations' WHEN o_orderkey % 11 = 0 THEN 'stop_dead_end' WHEN o_orderstatus = 'F' THEN 'finish' WHEN o_orderstatus = 'O' THEN 'revise' ELSE 'replan' END AS decision FROM orders""")
def termination_order(spark, d):
    k = F.col("o_orderkey")
    s = _t(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("cost_usd"), F.lit(50.0).alias("reserved_usd"), F.lit(400.0).alias("max_usd"), (k % 97 * 40000).alias("tokens"), F.lit(3_000_000).alias("max_tokens"),
        (k % 17).alias("iterations"), F.lit(12).alias("max_iterations"), (k % 11 == 0).alias("dead_end"), F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "revise").otherwise("replan").alias("verdict"),
    )
    return ledger.termination(s).select("o_orderkey", "decision")


@_register("""SELECT o_orderkey, CASE WHEN v IN ('accept', 'revise') AND b > 0 THEN 'replan' WHEN v = 'accept' AND c >= 0.85 AND e = 0 AND r < 2 THEN 'revise' WHEN v = 'revise' AND r >= 2 THEN 'accept' ELSE v END AS decision
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'revise' ELSE 'replan' END AS v, o_orderkey % 5 // 4 AS b, (o_orderkey % 10) / 10.0::DOUBLE AS c, o_orderkey % 4 AS e, o_orderkey % 7 // 2 AS r FROM orders)""")
def guarded_verdicts(spark, d):
    k = F.col("o_orderkey")
    r = _t(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "accept").when(k % 3 == 1, "revise").otherwise("replan").alias("verdict"), F.floor(k % 5 / 4).alias("blocking_steps"), (k % 10 / 10).alias("confidence"),
        (k % 4).alias("evidence_count"), F.floor(k % 7 / 2).alias("revisions"),
    )
    return ledger.guard_verdicts(r).select("o_orderkey", "decision")


_STEPS = "steps AS (SELECT CAST(o_custkey AS VARCHAR) AS plan_id, 's' || CAST(o_orderkey AS VARCHAR) AS step_id, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 'emulator' ELSE 'kb' END AS tool FROM orders)"
_RESULTS = "results AS (SELECT CAST(o_custkey AS VARCHAR) AS plan_id, 's' || CAST(o_orderkey AS VARCHAR) AS step_id, o_orderkey % 3 = 0 AS ok FROM orders WHERE o_orderkey % 5 IN (0, 1))"


def _ledger(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("plan_id"), F.concat(F.lit("s"), k.cast("string")).alias("step_id"), k)
    steps = o.select("plan_id", "step_id", k.alias("pos"), F.when(k % 4 == 0, "emulator").otherwise("kb").alias("tool"), F.lit("{}").alias("args"), F.array().cast("array<string>").alias("depends_on"))
    results = o.where(k % 5 < 2).select("plan_id", "step_id", (k % 3 == 0).alias("ok"), F.lit(True).alias("retryable"), F.lit(None).cast("string").alias("rejection"), F.lit(None).cast("string").alias("outcome"), k.alias("result_pos"))
    return steps, results


@_register(f"""WITH {_STEPS}, {_RESULTS}, fresh AS (SELECT s.* FROM steps s LEFT JOIN results r USING (plan_id, step_id) WHERE r.step_id IS NULL AND tool = 'kb'),
n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY plan_id) AS c FROM fresh) SELECT plan_id, step_id FROM n WHERE n <= 4 AND c >= 2""")
def fan_out_batch(spark, d):
    return ledger.fan_out(*_ledger(spark, d)).select("plan_id", "step_id")


@_register(f"""WITH {_STEPS}, {_RESULTS} SELECT plan_id, step_id, CASE WHEN ok THEN 0 WHEN ok IS NULL THEN 0 ELSE 1 END::BIGINT AS fails, coalesce(ok, false) AS succeeded, NOT coalesce(ok, false) AS pending FROM steps LEFT JOIN results USING (plan_id, step_id)""")
def step_states(spark, d):
    return ledger.step_status(*_ledger(spark, d)).select("plan_id", "step_id", "fails", "succeeded", "pending")


@_register(r"""WITH r AS (SELECT conv_id, turn, substr(sha256('s' || (conv_id % 5)::VARCHAR || chr(1) || role || chr(1) || substr(md5(text), 1, 1)), 1, 20) AS h, conv_id * 100 + turn AS p FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p) AS n FROM r) SELECT conv_id, turn, h || CASE WHEN n > 1 THEN '_' || n::VARCHAR ELSE '' END AS result_id FROM n""")
def result_ids(spark, d):
    c = _t(spark, d, "conversations")
    r = c.select("conv_id", "turn", F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("step_id"), F.col("role").alias("tool"), F.substring(F.md5(F.col("text").cast("binary")), 1, 1).alias("data"), (F.col("conv_id") * 100 + F.col("turn")).alias("result_pos"))
    return ledger.result_identity(r).select("conv_id", "turn", "result_id")


@_register(f"WITH {_LOG} SELECT log_pos, CASE WHEN log_pos % 3 = 0 THEN payload ELSE 'own ' || log_pos::VARCHAR END AS data FROM log")
def rehydrated_payloads(spark, d):
    log = _log(spark, d)
    results = log.select("log_pos", F.col("log_pos").alias("event_id"), F.when(F.col("log_pos") % 3 != 0, F.concat(F.lit("own "), F.col("log_pos").cast("string"))).alias("data"))
    return ledger.rehydrate(results, log.select(F.col("log_pos").alias("event_id"), F.col("payload").alias("data"))).select("log_pos", "data")


@_register(f"""WITH {_ROUTINES}, c AS (SELECT p_partkey, CAST(p_partkey % 4096 AS INT) AS addr FROM part)
SELECT p_partkey, CASE WHEN max(r."start") IS NOT NULL THEN 'fact' ELSE 'hypothesis' END AS kind, CAST(CASE WHEN max(r."start") IS NULL THEN 1 ELSE 0 END AS INT) AS flagged FROM c LEFT JOIN routines r ON addr BETWEEN r."start" AND r."end" GROUP BY p_partkey""")
def gated_claims(spark, d):
    claims = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4096).cast("int").alias("addr"))
    return fold.gate_claims(claims, _routines(spark, d).select("start", "end")).select("p_partkey", "kind", F.size("flags").alias("flagged"))


@_register("""WITH f AS (SELECT l_orderkey AS result_id, CASE WHEN l_linestatus = 'F' THEN 'loops' ELSE 'vectors' END AS mode, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_quantity AS score FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY result_id, mode ORDER BY ord) AS n FROM f) SELECT result_id, mode, ord, least(0.75, 0.4 + score / 60) AS confidence FROM n WHERE n <= CASE mode WHEN 'loops' THEN 3 ELSE 8 END""")
def capped_findings(spark, d):
    ord_ = (F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    f = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.when(F.col("l_linestatus") == "F", "loops").otherwise("vectors").alias("mode"), ord_.alias("ord"), ord_.alias("addr"), F.lit("x").alias("name"), F.col("l_quantity").alias("score"))
    return fold.mechanical_facts(f).select("result_id", "mode", F.col("addr").alias("ord"), "confidence")


@_register(f"WITH {_LOG} SELECT log_pos, kind FROM log WHERE log_pos > 4000")
def replayed_tail(spark, d):
    return fold.catch_up(_log(spark, d), 4000, "same", "same").select("log_pos", "kind")


@_register(f"WITH {_LOG} SELECT * FROM (SELECT log_pos, length(payload) AS n FROM log WHERE (SELECT sum(length(payload)) // 4 FROM log) > 100 ORDER BY log_pos LIMIT 20)")
def gated_backlog(spark, d):
    results = _log(spark, d).select(F.col("log_pos").alias("event_id"), F.col("log_pos").alias("ts"), "payload")
    none = results.select(F.array("event_id").alias("events_compacted")).limit(0)
    return fold.backlog_batch(results, none, 100).select(F.col("event_id").alias("log_pos"), F.length("payload").cast("long").alias("n"))


@_register("SELECT event_id FROM events WHERE event_type IN ('click', 'view') OR user_id % 7 = 3")
def kinds_or_aliases(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("user_id") % 7 == 3, F.array(F.lit("timer"))).alias("alias_kinds"))
    return e.where(heuristics.kinds_wanted("click| View |timer")).select("event_id")


@_register(r"""WITH r AS (SELECT conv_id, turn, (turn % 4 + 1) / 5.0::DOUBLE * (1 + len(list_intersect(['the', 'which', 'zzz'], regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) / 3::DOUBLE) AS p FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC, turn) AS place FROM r) SELECT conv_id, turn, CAST(place AS INT) AS place FROM n WHERE place <= 2""")
def best_two_candidates(spark, d):
    c = _t(spark, d, "conversations").withColumn("confidence", (F.col("turn") % 4 + 1) / F.lit(5.0))
    return retrieval.best_candidates(c, "The which, zzz of it", "text", ["conv_id"], "turn").select("conv_id", "turn", "place")


@_register(r"""WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'planner' WHEN 1 THEN 'executor' WHEN 2 THEN 'critic' ELSE 'analyst' END AS role, CASE event_id % 3 WHEN 0 THEN '{"plan": [], "decision": "accept"}' WHEN 1 THEN '{"plan": [1], "args": {}, "tool": "kb"}' ELSE 'no' END AS answer FROM events)
SELECT event_id, CASE WHEN answer = 'no' THEN 'no object' WHEN role = 'planner' AND answer LIKE '%[]%' THEN 'planner: plan is no filled list' WHEN role = 'executor' AND answer LIKE '%[]%' THEN 'executor: args is no object'
WHEN role = 'critic' AND answer NOT LIKE '%accept%' THEN 'critic: decision is no one of accept, revise, replan' END AS error FROM a""")
def role_errors(spark, d):
    k = F.col("event_id")
    role = F.when(k % 4 == 0, "planner").when(k % 4 == 1, "executor").when(k % 4 == 2, "critic").otherwise("analyst")
    answer = F.when(k % 3 == 0, '{"plan": [], "decision": "accept"}').when(k % 3 == 1, '{"plan": [1], "args": {}, "tool": "kb"}').otherwise("no")
    return _t(spark, d, "events").select("event_id", role.alias("role"), answer.alias("answer")).select("event_id", modes.role_error().alias("error"))


@_register(f"""WITH {_ROUTINES}, {_EDGES} SELECT DISTINCT r."start" AS "start", e.src, e.dst FROM routines r JOIN edges e ON e.dst BETWEEN r."start" AND r."end" """)
def edges_into_routines(spark, d):
    return intervals.smallest_containing(_edges(spark, d).select("src", "dst").distinct(), _routines(spark, d).select("start", "end"), "dst", (), False).where("start is not null").select("start", "src", "dst")

"""Registered queries of notes, labels, runs, vectors, plans, budgets, event stores and byte checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrel.functions import text as T
from petrel.operators import fold, graph, ledger, memdiff, postings, retrieval
from petrel.plans.catalog import _RESULTS, _STEPS, _ledger
from petrel.plans.registry import _EDGES, _ROUTINES, _edges, _register, _routines, _t


def _text(c):
    return c.cast("string")


@_register("""SELECT doc_id, CAST("offset" AS INT) AS "offset", min(term) AS term FROM (SELECT doc_id, strpos(lower(text), term) - 1 AS "offset", term FROM documents, (VALUES ('the'), ('th'), ('der')) v(term))
WHERE "offset" >= 0 GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 300""")
def note_hits(spark, d):
    return retrieval.search_notes(_t(spark, d, "documents"), ["The", "th", "der"], 300, "doc_id", "text")


_LABELS = "labels AS (SELECT CAST(p_partkey % 4096 AS INT) AS addr, p_name AS name, p_type AS kind, (p_size % 10) / 10.0::DOUBLE AS confidence FROM part)"


def _labels(spark, d):
    return _t(spark, d, "part").select((F.col("p_partkey") % 4096).cast("int").alias("addr"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") % 10 / 10).alias("confidence"))


@_register(f"""WITH {_LABELS} SELECT * FROM (SELECT * FROM labels WHERE addr IN (16, 64) OR contains(lower(name), 'cold') ORDER BY CASE WHEN addr IN (16, 64) THEN 0 ELSE 1 END, confidence DESC, addr, name, kind LIMIT 40)""")
def labels_relevant(spark, d):
    return retrieval.relevant_labels(_labels(spark, d), "Where is the cold of $0010, and what of 0x40?", 40)


@_register(f"WITH {_LABELS} SELECT * FROM labels ORDER BY confidence DESC, addr, name LIMIT 20")
def labels_surest(spark, d):
    return retrieval.relevant_labels(_labels(spark, d), "What is the zzzyx?", 40)


_RUNS = "runs AS (SELECT event_id AS run_id, event_type AS question, CASE event_id % 3 WHEN 0 THEN 'accept' ELSE 'replan' END AS verdict, ts FROM events)"


def _runs(spark, d):
    k = F.col("event_id")
    return _t(spark, d, "events").select(k.alias("run_id"), F.col("event_type").alias("question"), F.when(k % 3 == 0, "accept").otherwise("replan").alias("verdict"), "ts")


@_register(f"WITH {_RUNS} SELECT run_id, question FROM runs WHERE verdict = 'accept' AND question <> 'click' ORDER BY ts DESC, run_id DESC LIMIT 6")
def answers_prior(spark, d):
    return retrieval.prior_answers(_runs(spark, d), " Click ").select("run_id", "question")


@_register(f"WITH {_RUNS} SELECT run_id, question FROM runs ORDER BY CASE WHEN question = 'view' THEN 0 ELSE 1 END, ts DESC, run_id DESC LIMIT 100")
def runs_recent(spark, d):
    return retrieval.recent_runs(_runs(spark, d), "view", 5000).select("run_id", "question")


@_register("""SELECT conv_id * 100 + turn AS event_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '…[truncated]' ELSE text END AS excerpt FROM conversations WHERE turn % 2 = 1 ORDER BY turn DESC, conv_id * 100 + turn DESC LIMIT 12""")
def excerpts_recent(spark, d):
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("event_id"), F.col("turn").alias("ts"), F.col("text").alias("data"))
    return retrieval.recent_excerpts(c, c.where("ts % 2 = 0").select("event_id"), 12, 50).select("event_id", "excerpt")


@_register(r"""WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents ORDER BY doc_id LIMIT 1), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM f)
SELECT doc_id AS path, CAST(n AS INT) AS line_no, line FROM x WHERE n < 120""")
def listing_first(spark, d):
    return retrieval.listing_head(_t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("log_pos")))


@_register("SELECT event_id AS id, event_type AS summary, CAST(user_id AS VARCHAR) AS covered FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 3")
def summaries_latest(spark, d):
    e = _t(spark, d, "events")
    payload = F.to_json(F.struct(F.col("event_type").alias("summary"), F.array(_text(F.col("user_id"))).alias("events_compacted")))
    log = e.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "compaction").otherwise("label").alias("kind"), payload.alias("payload"))
    return retrieval.consolidated_summaries(log).select("id", "summary", F.col("events_compacted")[0].alias("covered"))


@_register("""WITH r AS (SELECT p_partkey, CAST(p_partkey AS INT) AS requested, CAST((p_partkey * 37 + p_size) % 4096 AS INT) AS first FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN first END AS first, CASE WHEN p_partkey % 5 > 0 AND (first - requested < -32 OR first - requested > 256) THEN 'response starts at $' || printf('%04X', first) END AS warning FROM r""")
def address_warnings(spark, d):
    k = F.col("p_partkey")
    said = F.when(k % 5 > 0, F.concat(F.lit("dump of "), T.hex_label((k * 37 + F.col("p_size")) % 4096), F.lit(" and $FFFF"))).otherwise("no address")
    return retrieval.address_parity(_t(spark, d, "part").select(k, k.cast("int").alias("requested"), said.alias("response"))).select("p_partkey", "first", "warning")


@_register("SELECT p_partkey FROM part WHERE p_partkey % 64 = 33 AND p_size % 4 < 2")
def writes_in_text(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    line = F.concat(F.when(s == 0, "1000: sta ").when(s == 1, "INC ").when(s == 2, "LDA ").otherwise("CMP "), F.lit("$"), F.hex(k % 64), F.lit("  ; $0021"))
    return retrieval.direct_writes(_t(spark, d, "part").select(k, line.alias("line")), 33).select("p_partkey")


@_register("SELECT p_partkey FROM (SELECT * FROM part WHERE contains(lower(p_name), 'widget') AND p_type = 'ECONOMY' ORDER BY p_partkey) LIMIT 3 OFFSET 3")
def catalog_second_page(spark, d):
    p = _t(spark, d, "part")
    c = p.select("p_partkey", F.lpad(_text(F.col("p_partkey")), 12, "0").alias("name"), F.col("p_name").alias("notes"), F.col("p_type").alias("status"))
    return retrieval.catalog_page(c, "Widget", "ECONOMY", 2, 3).select("p_partkey")


@_register("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'fresh' ELSE 'old' END AS vector FROM conversations WHERE conv_id % 3 > 0 OR turn % 2 = 0")
def vectors_replaced(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn")
    return retrieval.replace_vectors(c.withColumn("vector", F.lit("old")), c.where("conv_id % 3 = 0 and turn % 2 = 0").withColumn("vector", F.lit("fresh")), "conv_id").select("conv_id", "turn", "vector")


@_register("""WITH c AS (SELECT DISTINCT text, sha256('m' || chr(1) || sha256(text)) AS cache_key FROM conversations)
SELECT cache_key, text FROM c WHERE cache_key NOT IN (SELECT sha256('m' || chr(1) || sha256(text)) FROM conversations WHERE turn = 0 AND conv_id % 2 = 0)""")
def vectors_missing(spark, d):
    c = _t(spark, d, "conversations").withColumn("pos", F.col("conv_id") * 100 + F.col("turn"))
    key = F.sha2(F.concat_ws("\u0001", F.lit("m"), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256)
    size = F.when(F.col("conv_id") % 2 == 0, 4).otherwise(3)
    return retrieval.embedding_misses(c.select("pos", "text"), c.where("turn = 0").select(key.alias("cache_key"), F.array_repeat(F.lit(0.5), size).alias("vector")).distinct(), "m", 4)


@_register(r"""SELECT substr(sha1('names' || chr(1) || p_brand || chr(1) || p_name), 1, 16) AS chunk_id, 'names' AS facet, p_partkey FROM part
UNION ALL SELECT substr(sha1('types' || chr(1) || p_brand || chr(1) || p_type), 1, 16), 'types', NULL FROM part WHERE p_size = 7""")
def chunk_ids(spark, d):
    p = _t(spark, d, "part")
    names = p.select(F.col("p_brand").alias("source"), F.col("p_name").alias("text"))
    got = retrieval.collect_chunks({"types": p.where("p_size = 7").select(F.col("p_brand").alias("source"), F.col("p_type").alias("text")), "names": names})
    again = p.select("p_partkey", F.col("p_brand").alias("source"), F.col("p_name").alias("text"), F.lit("names").alias("facet"))
    return got.distinct().join(again, ["facet", "source", "text"], "right").select("chunk_id", "facet", "p_partkey").unionByName(got.where("facet = 'types'").select("chunk_id", "facet", F.lit(None).cast("long").alias("p_partkey")))


@_register("""WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE '' END || CAST(o_orderkey % 3 AS VARCHAR) AS b FROM orders), t AS (SELECT *, CASE WHEN b LIKE 's%' THEN b ELSE 's' || b END AS base FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, base ORDER BY o_orderkey) AS n FROM t) SELECT o_orderkey, base || CASE WHEN n > 1 THEN '_' || CAST(n AS VARCHAR) ELSE '' END AS step_id, 's' || CAST(o_orderkey % 4 AS VARCHAR) AS dep FROM n""")
def plan_ids(spark, d):
    k = F.col("o_orderkey")
    steps = _t(spark, d, "orders").select(k, F.col("o_custkey").alias("plan_id"), k.alias("pos"), F.concat(F.when(k % 2 == 0, "s").otherwise(""), _text(k % 3)).alias("step_id"), F.array(F.concat(F.when(k % 5 == 0, "s").otherwise(""), _text(k % 4))).alias("depends_on"))
    return ledger.normalise_plan(steps).select("o_orderkey", "step_id", F.col("depends_on")[0].alias("dep"))


@_register("""SELECT event_id, CASE WHEN cut THEN least(c, 0.4::DOUBLE) ELSE c END AS confidence, CASE WHEN NOT cut OR event_id % 4 = 0 THEN notes ELSE coalesce(notes || '; ', '') || 'run was cut short' END AS notes, CASE WHEN cut AND event_id % 2 = 0 THEN 'truncated' WHEN event_id % 2 = 0 THEN 'accept' ELSE 'replan' END AS verdict
FROM (SELECT event_id, value / 100 AS c, user_id % 3 = 0 AS cut, CASE event_id % 4 WHEN 0 THEN 'run was cut short' WHEN 1 THEN 'slow' END AS notes FROM events)""")
def runs_cut(spark, d):
    k = F.col("event_id")
    r = _t(spark, d, "events").select(k, (F.col("value") / 100).alias("confidence"), (F.col("user_id") % 3 == 0).alias("truncated"), F.when(k % 4 == 0, "run was cut short").when(k % 4 == 1, "slow").alias("notes"), F.when(k % 2 == 0, "accept").otherwise("replan").alias("verdict"))
    return ledger.truncated_runs(r).select("event_id", "confidence", "notes", "verdict")


@_register("SELECT event_type AS tool, CAST(sum(user_id) AS BIGINT) AS calls, CAST(sum(event_id % 3) AS BIGINT) AS failures FROM events GROUP BY 1")
def counters_merged(spark, d):
    return ledger.merge_counters(_t(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("calls"), (F.col("event_id") % 3).alias("failures")))


@_register("""SELECT o_orderkey, CAST(sum(o_orderkey % 50) OVER w AS BIGINT) AS spent, CAST(sum(o_orderkey % 7 + o_orderkey % 11) OVER w AS BIGINT) AS tokens, sum(o_orderkey % 50) OVER w + 20 <= 150 AS fits FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def spend_so_far(spark, d):
    k = F.col("o_orderkey")
    calls = _t(spark, d, "orders").select(k, F.col("o_custkey").alias("run_id"), k.alias("pos"), (k % 50).alias("cost_usd"), (k % 7).alias("input_tokens"), (k % 11).alias("output_tokens"), F.lit(20).alias("reserve_usd"), F.lit(150).alias("max_usd"))
    return ledger.running_spend(calls).select("o_orderkey", "spent", "tokens", "fits")


@_register("SELECT event_id, NOT (event_type IN ('view', 'click') OR (event_type = 'error' AND user_id % 2 = 0)) AS mutating FROM events")
def calls_mutating(spark, d):
    e = _t(spark, d, "events")
    kind = F.col("event_type")
    calls = e.select("event_id", F.when(kind == "error", "stopwatch").otherwise(kind).alias("method"), F.when(F.col("user_id") % 2 == 0, "read").when(F.col("user_id") % 3 == 0, "reset").alias("action"))
    return ledger.mutating(calls, spark.createDataFrame([("view",), ("click",)], "method string")).select("event_id", "mutating")


@_register("""SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 'error' WHEN user_id % 3 > 0 THEN 'confirmed' WHEN event_id % 5 > 2 THEN 'error' ELSE 'inconclusive' END AS outcome FROM events""")
def trace_verdicts(spark, d):
    k = F.col("event_id")
    t = _t(spark, d, "events").select(k, F.when(k % 11 > 0, k).alias("trace_id"), F.when(k % 7 == 0, "stopped").alias("run_error"), (F.col("user_id") % 3).alias("hits"), F.when(k % 5 > 2, k % 5).alias("poll_errors"))
    return ledger.trace_outcomes(t).select("event_id", "outcome")


@_register("""WITH c AS (SELECT conv_id * 100 + turn AS id, lower(text) AS t, CAST(conv_id % 64 AS INT) AS a, turn / 4.0::DOUBLE AS conf FROM conversations)
SELECT id, CASE WHEN a % 2 = 0 THEN 0 ELSE 1 END AS no_address, CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])the($|[^a-z0-9_])') THEN 0 ELSE 1 END AS no_word, conf >= 0.5 AS confident, a % 2 = 0 AND conf >= 0.5 AND regexp_matches(t, '(^|[^a-z0-9_])the($|[^a-z0-9_])') AS passed FROM c""")
def golden_scores(spark, d):
    c = _t(spark, d, "conversations")
    i, a = F.col("conv_id") * 100 + F.col("turn"), (F.col("conv_id") % 64).cast("int")
    cases = c.select(i.alias("id"), F.array(a).alias("expected_addresses"), F.array(F.lit("The")).alias("expected_keywords"), F.lit(0.5).alias("min_confidence"))
    answers = c.select(i.alias("id"), "text", (F.col("turn") / 4).alias("confidence"), F.array(F.when(a % 2 == 0, a).otherwise(a + 1), F.lit(900)).alias("addresses"))
    return ledger.evaluate_golden(cases, answers).select("id", F.size("missing_addresses").alias("no_address"), F.size("missing_keywords").alias("no_word"), "confident", "passed")


@_register("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE greatest(0, least(1, value / 100 - 0.5)) END::DOUBLE AS confidence, CASE WHEN event_id % 3 = 0 THEN event_type END AS idiom, 0 AS evidence, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || chr(10) || 'Motivation: why' END AS summary FROM events""")
def annotations_clean(spark, d):
    k = F.col("event_id")
    a = _t(spark, d, "events").select(k, F.when(k % 4 > 0, F.col("value") / 100 - 0.5).alias("confidence"), F.when(k % 3 == 0, F.col("event_type")).when(k % 3 == 1, " None ").otherwise("").alias("idiom"), F.lit(None).cast("array<string>").alias("evidence"), F.when(k % 2 == 1, "why").otherwise("").alias("motivation"), F.col("event_type").alias("summary"))
    return ledger.clean_annotations(a).select("event_id", "confidence", "idiom", F.size("evidence").alias("evidence"), "summary")


@_register(f"""WITH {_STEPS}, r AS (SELECT *, CAST(substr(step_id, 2) AS BIGINT) AS k FROM ({_RESULTS.removeprefix("results AS ")})) SELECT plan_id, step_id, CASE WHEN k % 2 = 0 THEN 'invalid' ELSE 'failed' END AS note FROM steps JOIN r USING (plan_id, step_id) WHERE NOT ok""")
def step_notes_failed(spark, d):
    steps, results = _ledger(spark, d)
    results = results.withColumns({"retryable": F.lit(False), "rejection": F.when(F.col("result_pos") % 2 == 0, "invalid")})
    return ledger.failed_notes(steps, results).select("plan_id", "step_id", "note")


@_register("""SELECT 'hyp-' || CAST(o_orderkey AS VARCHAR) || '-x' AS hyp_id, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' WHEN o_orderkey % 3 = 1 THEN 'refuted' ELSE 'open' END AS status,
CAST(1 + CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS INT) AS evidence FROM orders""")
def hypothesis_lifecycle(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(k, F.concat(F.lit("hyp-"), _text(k), F.lit("-x")).alias("hyp_id"), F.concat(F.lit("ev"), _text(k)).alias("event_id"))
    hyps = o.select("hyp_id", "event_id", F.lit("open").alias("status"), F.array(F.lit("seen")).alias("evidence"))
    by_event = o.where(k % 3 == 0).select(F.col("event_id").alias("ref"), F.lit("confirmed").alias("status"), F.array(F.lit("seen"), F.lit("trace")).alias("evidence"), k.alias("log_pos"))
    by_prefix = o.where(k % 3 == 1).select(F.concat(F.lit("hyp-"), _text(k), F.lit("-")).alias("ref"), F.lit("refuted").alias("status"), F.array(F.lit("run")).alias("evidence"), k.alias("log_pos"))
    vague = o.where(k % 3 == 2).select(F.lit("hyp-").alias("ref"), F.lit("lost").alias("status"), F.array(F.lit("no")).alias("evidence"), k.alias("log_pos"))  # fits many, so none
    return fold.hypothesis_states(hyps, by_event.unionByName(by_prefix).unionByName(vague)).select("hyp_id", "status", F.size("evidence").alias("evidence"))


@_register("""WITH s AS (SELECT o_custkey % 200 AS plan_id, o_orderkey % 40 AS s, o_orderkey AS k FROM orders)
SELECT plan_id, 'duplicate_id' AS problem, CAST(s AS VARCHAR) AS step_id, NULL AS detail FROM s GROUP BY plan_id, s HAVING count(*) > 1
UNION ALL SELECT plan_id, 'unknown_dependency', CAST(s AS VARCHAR), 'none' FROM s WHERE k % 5 = 0""")
def plan_problems(spark, d):
    k = F.col("o_orderkey")
    steps = _t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("plan_id"), _text(k % 40).alias("step_id"), F.when(k % 5 == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    return graph.validate_plan(steps)


@_register("""SELECT DISTINCT CAST(l_partkey AS INT) AS src, CAST(l_suppkey AS INT) AS dst, CASE WHEN l_linestatus = 'F' THEN 'r' ELSE 'w' END AS access, CASE WHEN l_linenumber % 2 = 0 THEN 'x' END AS "index" FROM lineitem
WHERE l_suppkey = 3 AND l_linestatus = 'F' ORDER BY src, access, "index" NULLS FIRST LIMIT 200""")
def refs_to_target(spark, d):
    li = _t(spark, d, "lineitem")
    refs = li.select(F.col("l_partkey").cast("int").alias("src"), F.col("l_suppkey").cast("int").alias("dst"), F.when(F.col("l_linestatus") == "F", "r").otherwise("w").alias("access"), F.when(F.col("l_linenumber") % 2 == 0, "x").alias("index"))
    return graph.refs_to(refs, 3, "r")


@_register("""WITH a AS (SELECT event_id, CAST((user_id * 8) % 65536 AS BIGINT) AS lo, event_type FROM events WHERE event_type <> 'error'), b AS (SELECT event_id, CAST(unnest(range(lo, lo + 4)) AS INT) AS addr, event_type FROM a)
SELECT addr, event_id AS log_pos, event_type AS class FROM (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY event_id DESC) AS n FROM b) WHERE n = 1""")
def byte_classes(spark, d):
    e, lo = _t(spark, d, "events"), (F.col("user_id") * 8 % 65536).cast("int")
    kind = F.when(F.col("event_type") == "error", "label").otherwise("byte_class")
    ann = e.select(
        _text(F.col("event_id")).alias("id"), F.col("event_id").alias("log_pos"), kind.alias("kind"), lo.alias("range_start"), (lo + 3).alias("range_end"), F.to_json(F.struct(F.col("event_type").alias("class"))).alias("payload"),
        F.lit("a.lst").alias("source_file"), F.lit(1.0).alias("confidence"),
    )
    return fold.annotations_to_views(ann)["code_class"].select("addr", "log_pos", "class")


@_register("""WITH l AS (SELECT event_id, CAST(user_id % 16 AS INT) AS addr, event_type AS name, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE (event_id % 10) / 10.0::DOUBLE END AS c, CASE WHEN event_id % 4 > 0 THEN (event_id % 10) / 10.0::DOUBLE END AS confidence FROM events WHERE event_id % 2 = 0)
SELECT addr, name, CAST(event_id AS VARCHAR) AS id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY addr, name ORDER BY c DESC, event_id DESC) AS n FROM l) WHERE n = 1""")
def label_view(spark, d):
    k = F.col("event_id")
    payload = F.to_json(F.struct((F.col("user_id") % 16).cast("int").alias("addr"), F.col("event_type").alias("name"), F.when(k % 4 > 0, k % 10 / 10).alias("confidence")))
    log = _t(spark, d, "events").select(_text(k).alias("id"), k.alias("log_pos"), "ts", F.when(k % 2 == 0, "label").otherwise("usage").alias("kind"), payload.alias("payload"))
    return fold.views(log)["labels"].select("addr", "name", "id", "confidence")


@_register("""SELECT p_partkey, '$' || printf('%04X', (p_partkey + 256) % 65536) || CASE WHEN p_size <> 0 THEN ' $' || printf('%04X', (p_partkey + 256 + p_size) % 65536) ELSE '' END AS found FROM part""")
def prose_spans(spark, d):
    k = (F.col("p_partkey") + 256) % 65536
    text = F.concat(F.lit("see "), T.hex_label((k + F.col("p_size")) % 65536), F.lit(", then "), T.hex_label(k), F.lit(" - $FFFF, again "), T.hex_label(k), F.lit(" not $123"))
    found = T.prose_addresses(text)
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda a: T.hex_label(a)), " ").alias("found"))


@_register("SELECT CAST(event_id AS VARCHAR) AS id, row_number() OVER (ORDER BY ts, event_id) AS log_pos FROM events")
def log_numbers(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), "ts", "event_id")
    late = e.where("event_id % 9 = 0").withColumn("ts", F.col("ts") + F.expr("interval 900 days"))  # the same ids once more keep their numbers
    return fold.number_log(e.unionByName(late), "ts", "event_id").select("id", "log_pos")


@_register(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM conversations) SELECT conv_id, turn, len(list_intersect(w, ['the', 'tion', 'zzz', 'and'])) / 4.0::DOUBLE AS overlap FROM t""")
def term_overlap(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.lexical_overlap(F.array(*map(F.lit, ("the", "tion", "zzz", "and"))), words).alias("overlap"))


@_register("""SELECT p_partkey, printf('%02X%02X', p_size % 256, p_partkey % 256) AS raw, CASE WHEN p_size BETWEEN 1 AND 31 THEN chr(p_size + 64) WHEN p_size BETWEEN 32 AND 63 THEN chr(p_size) END AS shown FROM part""")
def payload_bytes(spark, d):
    pair = lambda c: F.lpad(F.hex(c), 2, "0")
    text = F.concat(F.lit("$"), pair(F.col("p_size") % 256), F.lit(", 0x"), F.lower(pair(F.col("p_partkey") % 256)))
    return _t(spark, d, "part").select("p_partkey", F.hex(T.hex_bytes(text)).alias("raw"), T.screen_char(F.col("p_size") + 128 * (F.col("p_partkey") % 2).cast("int")).alias("shown"))


@_register("""WITH t AS (SELECT DISTINCT s_suppkey AS k FROM supplier) SELECT CASE k % 4 WHEN 0 THEN s WHEN 1 THEN '$' || printf('%04X', k) WHEN 2 THEN 'hyp-' || s || '-' ELSE 'event-' || s END AS token,
CASE k % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'address' WHEN 2 THEN 'hypothesis' ELSE 'event' END AS type, CASE k % 4 WHEN 0 THEN s WHEN 1 THEN 'label ' || s WHEN 2 THEN 'hyp-' || s || '-x' ELSE 'event-' || s END AS target FROM (SELECT k, printf('%06d', k) AS s FROM t)""")
def evidence_targets(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lpad(_text(F.col("s_suppkey")), 6, "0").alias("s"))
    k, c = F.col("k"), F.concat
    token = F.when(k % 4 == 0, F.col("s")).when(k % 4 == 1, T.hex_label(k)).when(k % 4 == 2, c(F.lit("hyp-"), "s", F.lit("-"))).otherwise(c(F.lit("event-"), "s"))
    labels = s.select(k.cast("int").alias("addr"), c(F.lit("label "), "s").alias("name"), F.lit(0.9).alias("confidence"))
    return retrieval.resolve_evidence(s.select(token.alias("token")), s.select(F.col("s").alias("path")), labels, s.select(c(F.lit("hyp-"), "s", F.lit("-x")).alias("hyp_id")), s.select(c(F.lit("event-"), "s").alias("id")))


@_register("""SELECT p_partkey, CAST(p_partkey % 65536 AS INT) AS addr, CASE p_size % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN 'x' END AS "index", p_size % 4 >= 2 AS indirect FROM part""")
def operand_parts(spark, d):
    k, s = F.col("p_partkey") % 65536, F.col("p_size") % 4
    op = F.when(s == 0, F.concat(F.lit("0x"), F.hex(k))).when(s == 1, F.concat(T.hex_label(k), F.lit(",X"))).when(s == 2, F.concat(F.lit("("), T.hex_label(k), F.lit("),Y"))).otherwise(F.concat(F.lit("("), T.hex_label(k), F.lit(",x)")))
    facts = T.operand_facts(op)
    return _t(spark, d, "part").select("p_partkey", *[facts[n].alias(n) for n in ("addr", "index", "indirect")])


@_register("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '$' || printf('%X', p_partkey) || ',x' ELSE 'Loop' || CAST(p_partkey AS VARCHAR) END AS operand, CASE WHEN p_size % 2 = 1 THEN 'Loop' || CAST(p_partkey AS VARCHAR) END AS symbol FROM part""")
def operands_canonical(spark, d):
    k = F.col("p_partkey")
    op = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" 0x"), F.lower(F.hex(k)), F.lit(",x  ; at 0xff"))).otherwise(F.concat(F.lit("Loop"), _text(k), F.lit(" ; go")))
    one = T.canonical_operand(op)
    return _t(spark, d, "part").select("p_partkey", one.alias("operand"), T.label_ref(one).alias("symbol"))


_IMAGE = "img AS (SELECT CAST(p_partkey // 4096 * 3 + p_size % 3 AS VARCHAR) AS dump_id, CAST(p_partkey % 4096 AS INT) AS addr, CAST(CASE WHEN p_partkey % 7 = 0 THEN 141 WHEN p_partkey % 7 = 1 THEN 33 WHEN p_partkey % 7 = 2 THEN 208 ELSE p_partkey % 256 END AS INT) AS b FROM part)"


def _image(spark, d):
    k = F.col("p_partkey")
    b = F.when(k % 7 == 0, 141).when(k % 7 == 1, 33).when(k % 7 == 2, 208).otherwise(k % 256).cast("int")
    image = (F.floor(k / 4096) * 3 + F.col("p_size") % 3).cast("string")
    return _t(spark, d, "part").select(image.alias("dump_id"), (k % 4096).cast("int").alias("addr"), b.alias("b"), k)


@_register(f"""WITH {_IMAGE}, c AS (SELECT p_partkey AS case_id, CAST(p_partkey // 4096 * 3 + p_size % 3 AS VARCHAR) AS dump_id, CAST(p_partkey % 4096 AS INT) AS want FROM part WHERE p_partkey % 10 = 0)
SELECT case_id, want AS addr, true AS in_range, (SELECT coalesce(bool_or(i.b NOT IN (0, 255)), false) FROM img i WHERE i.dump_id = c.dump_id AND i.addr BETWEEN want AND want + 15) AS alive, case_id % 20 = 0 AS listed_ok FROM c""")
def anchors_checked(spark, d):
    img = _image(spark, d)
    at = img.where("p_partkey % 10 = 0")
    own = F.lpad(F.hex("b"), 2, "0")
    listing = at.select("dump_id", "addr", F.when(F.col("p_partkey") % 20 == 0, own).otherwise(F.concat(F.lit("zz "), own)).alias("bytes_hex"))
    return memdiff.validate_anchors(at.select(F.col("p_partkey").alias("case_id"), "dump_id", "addr"), img, listing).select("case_id", "addr", "in_range", "alive", "listed_ok")


@_register("SELECT CAST(user_id % 3 AS INT) AS high, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id <= 2000 GROUP BY 1")
def prefix_counts(spark, d):
    """Rows before a mark, by key; the prefix's fingerprint is checked not to depend on the partitioning."""
    log = _t(spark, d, "events").select(F.col("event_id").alias("log_pos"), _text(F.col("event_id")).alias("id"), F.col("user_id"))
    mark = log.agg(fold.prefix_fingerprint(log, 2000).alias("a")).join(log.where("log_pos <= 2000").repartition(5, "id").agg(fold.prefix_fingerprint(log, 2000).alias("b")), F.expr("a = b"))  # single rows
    same = log.where("log_pos <= 2000").join(F.broadcast(mark.select(F.lit(True).alias("_same"))), F.lit(True), "left_semi")
    return same.groupBy((F.col("user_id") % 3).cast("int").alias("high")).agg(F.count("*").alias("n"))


@_register("""SELECT conv_id, turn, CASE WHEN hit = 0 THEN substr(text, 1, 120) ELSE CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '...' ELSE '' END END AS snippet
FROM (SELECT *, greatest(1, hit - 40) AS a, least(length(text), hit - 1 + 40 + 4) AS b FROM (SELECT *, strpos(lower(text), 'tion') AS hit FROM conversations))""")
def turn_snippets(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text"), F.lit("Tion"), 120).alias("snippet"))


@_register(f"""WITH {_IMAGE}, n AS (SELECT *, lead(b, 1) OVER w AS lo, lead(b, 2) OVER w AS hi FROM img WHERE b IN (141, 33, 208) WINDOW w AS (PARTITION BY dump_id ORDER BY addr))
SELECT dump_id, addr AS site FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY addr) AS k FROM n WHERE b = 141 AND lo = 33 AND hi = 208) WHERE k <= 8""")
def stores_to_address(spark, d):
    img = _image(spark, d).where("b in (141, 33, 208)")  # stores, and the two bytes of one address
    return memdiff.reference_sites(img, 208 * 256 + 33)


@_register(f"""WITH {_ROUTINES}, {_EDGES}, r AS (SELECT * FROM routines WHERE 100 BETWEEN "start" AND "end" ORDER BY "end" - "start", "start" LIMIT 1)
SELECT DISTINCT e.src, e.dst, e.edge FROM edges e, r WHERE e.dst BETWEEN r."start" AND r."end" AND NOT (e.src BETWEEN r."start" AND r."end")""")
def callers_of_window(spark, d):
    code = _t(spark, d, "part").select(F.col("p_partkey").cast("int").alias("addr"))
    refs = _t(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("src"), (53248 + F.col("l_suppkey")).cast("int").alias("dst"), F.lit("r").alias("access"))
    return graph.routine_window(code, _routines(spark, d), _edges(spark, d), refs, 100)["callers"]


@_register("SELECT doc_id, CAST(instr(lower(text), 'ening the') - 1 AS INT) AS match_at FROM documents WHERE contains(lower(text), 'ening the')")
def text_by_trigrams(spark, d):
    """All documents with a phrase, by the postings of its trigrams."""
    docs = _t(spark, d, "documents")
    return postings.containing(docs, postings.postings(docs, "doc_id", "text"), "ENing the", "doc_id", "text")


@_register("""WITH t(term) AS (VALUES ('ing'), ('the '), ('zzzq'), ('über')), h AS (SELECT doc_id, term, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS n FROM documents, t)
SELECT doc_id, count_if(n > 0)::INT AS distinct_terms, sum(n)::BIGINT AS occurrences, (100 * count_if(n > 0) + least(sum(n), 20))::BIGINT AS score FROM h GROUP BY doc_id HAVING count_if(n > 0) > 0""")
def terms_counted(spark, d):
    return retrieval.term_hits(_t(spark, d, "documents"), ["ING", "the ", "zzzq", "über", "ing"], key="doc_id", content="text")


@_register("SELECT p_partkey, substr(p_name, 1, 7) AS p_name, p_size, '$' || printf('%04X', p_partkey % 65536) AS addr_hex FROM part")
def parts_previewed(spark, d):
    rows = _t(spark, d, "part").withColumn("addr", (F.col("p_partkey") % 65536).cast("int"))
    return retrieval.preview(rows, ["p_partkey", "p_name", "p_size"], 7, ["addr"])

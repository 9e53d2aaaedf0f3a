"""Registered queries over the driver tables and their DuckDB statements.

The tables stand in for the engine's own: suppliers are routines of sixteen addresses,
returned line items are call edges, events are hypotheses, facts and log rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrel.functions import isa
from petrel.functions import text as T
from petrel.operators import decode, fold, graph, heuristics, intervals, layer0, ledger, memdiff, retrieval
from petrel.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log: a confidence with many ties, a source that names a file."""
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").alias("log_pos"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.floor(F.col("value") / 10).alias("confidence"), F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("source_file"), F.col("props").alias("payload"), F.col("value"))


_LOG = "log AS (SELECT event_id AS log_pos, user_id AS key, event_type AS kind, CAST(floor(value / 10) AS BIGINT) AS confidence, event_type || '_' || CAST(user_id % 10 AS VARCHAR) AS source_file, props AS payload, value FROM events)"


def _routines(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    return s.select((F.col("s_suppkey") * 16).cast("int").alias("start"), (F.col("s_suppkey") * 16 + 15).cast("int").alias("end"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("sub_"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name")).alias("name"))


_ROUTINES = "routines AS (SELECT CAST(s_suppkey * 16 AS INT) AS \"start\", CAST(s_suppkey * 16 + 15 AS INT) AS \"end\", CASE WHEN s_suppkey % 3 = 0 THEN 'sub_' || CAST(s_suppkey AS VARCHAR) ELSE s_name END AS name FROM supplier)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").where("l_returnflag = 'A'")
    return li.select(F.col("l_partkey").cast("int").alias("src"), (F.col("l_suppkey") * 16 + F.col("l_linenumber")).cast("int").alias("dst"), F.when(F.col("l_linestatus") == "F", "jsr").otherwise("jmp").alias("edge")).distinct()


_EDGES = "edges AS (SELECT DISTINCT CAST(l_partkey AS INT) AS src, CAST(l_suppkey * 16 + l_linenumber AS INT) AS dst, CASE WHEN l_linestatus = 'F' THEN 'jsr' ELSE 'jmp' END AS edge FROM lineitem WHERE l_returnflag = 'A')"


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), ((F.col("user_id") % 100) * 16).cast("int").alias("start"), (F.col("value") / 100).alias("confidence"), F.concat(F.lit("hyp_"), F.col("event_type")).alias("name"))


_HYP = "hyp AS (SELECT event_id AS id, CAST((user_id % 100) * 16 AS INT) AS \"start\", value / 100 AS confidence, 'hyp_' || event_type AS name FROM events)"
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"start\" ORDER BY confidence DESC, id DESC) AS rn FROM hyp) WHERE rn = 1)"


@_register(f"""WITH {_ROUTINES}, {_EDGES}, {_HYP}, {_BEST},
callers AS (SELECT r."start", count(DISTINCT e.src) AS callers FROM routines r LEFT JOIN edges e ON e.dst BETWEEN r."start" AND r."end" GROUP BY 1)
SELECT r."start", r."end", CASE WHEN r.name <> '' AND r.name NOT LIKE 'sub_%' THEN r.name ELSE coalesce(b.name, r.name) END AS display_name, c.callers, b.confidence
FROM routines r JOIN callers c USING ("start") LEFT JOIN best b USING ("start")""")
def routine_ranking(spark, d):
    return graph.rank_routines(_routines(spark, d), _edges(spark, d), _hypotheses(spark, d))


@_register(f'WITH {_HYP}, {_BEST} SELECT id, "start", confidence, name FROM best')
def best_hypothesis(spark, d):
    return graph.best_hypothesis(_hypotheses(spark, d))


_COLS = ["key", "kind", "log_pos", "confidence", "value"]


@_register(f"WITH {_LOG} SELECT key, kind, log_pos, confidence, value FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY confidence DESC, log_pos DESC) AS n FROM log) WHERE n = 1")
def cas_latest_fact(spark, d):
    return fold.strongest_write(_log(spark, d).select(*_COLS), ["key", "kind"])


@_register(f"WITH {_LOG} SELECT key, kind, log_pos, confidence, value FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY log_pos DESC) AS n FROM log) WHERE n = 1")
def last_write(spark, d):
    return fold.last_write(_log(spark, d).select(*_COLS), ["key", "kind"])


@_register(f"WITH {_LOG} SELECT key, kind, log_pos, confidence, value FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY log_pos) AS n FROM log) WHERE n = 1")
def first_write(spark, d):
    return fold.first_write(_log(spark, d).select(*_COLS), ["key", "kind"])


@_register(f"""WITH {_LOG}, inv AS (SELECT CASE WHEN log_pos % 1000 = 0 THEN kind || '%' ELSE source_file END AS pattern, log_pos AS inv_pos FROM log WHERE log_pos % 500 = 0)
SELECT log_pos, key, source_file FROM log l WHERE NOT EXISTS (SELECT 1 FROM inv WHERE l.source_file LIKE inv.pattern AND l.log_pos < inv.inv_pos)""")
def source_invalidation(spark, d):
    log = _log(spark, d).select("log_pos", "key", "source_file", "kind")
    inv = log.where("log_pos % 500 = 0").select(F.when(F.col("log_pos") % 1000 == 0, F.concat("kind", F.lit("%"))).otherwise(F.col("source_file")).alias("pattern"), F.col("log_pos").alias("inv_pos"))
    return fold.survivors(log, inv).drop("kind")


@_register(f"""WITH {_LOG}, s AS (SELECT unnest(range(log_pos - 50, log_pos)) AS event_id FROM log WHERE log_pos % 100 = 0)
SELECT kind, count(*) AS n, CAST(floor(sum(length(payload)) / 4) AS BIGINT) AS tokens FROM log WHERE log_pos NOT IN (SELECT event_id FROM s) GROUP BY kind""")
def uncompacted_backlog(spark, d):
    log = _log(spark, d).withColumnRenamed("log_pos", "event_id")
    summaries = log.where("event_id % 100 = 0").select(F.sequence(F.col("event_id") - 50, F.col("event_id") - 1).alias("events_compacted"))
    left = fold.uncompacted(log, summaries)
    return left.groupBy("kind").agg(F.count("*").alias("n"), F.floor(F.sum(F.length("payload")) / 4).alias("tokens"))


@_register(f"WITH {_LOG} SELECT count(DISTINCT kind || chr(1) || payload) AS facts FROM log WHERE kind <> 'view' AND value >= 10")
def distinct_facts_by_identity(spark, d):
    log = _log(spark, d).select("kind", F.col("payload").alias("identity"), (F.col("value") >= 10).alias("ok"), F.lit(False).alias("read_only"))
    return fold.distinct_facts(log, ["view"])


@_register("SELECT event_type, count(*) AS n, max(event_id) AS last_id, CAST(floor(sum(length(props)) / 4) AS BIGINT) AS tokens FROM events GROUP BY event_type")
def event_stats(spark, d):
    return fold.log_stats(_t(spark, d, "events"), "event_type", "event_id", "props")


_NEST = "nest AS (SELECT CAST(s_suppkey * 16 AS INT) AS \"start\", CAST(s_suppkey * 16 + (s_suppkey % 7 + 1) * 20 AS INT) AS \"end\" FROM supplier)"


def _nest(spark, d):
    return _t(spark, d, "supplier").select((F.col("s_suppkey") * 16).cast("int").alias("start"), (F.col("s_suppkey") * 16 + (F.col("s_suppkey") % 7 + 1) * 20).cast("int").alias("end"))


@_register(f"""WITH {_NEST}, p AS (SELECT o_orderkey, CAST(o_orderkey % 4096 AS INT) AS addr FROM orders)
SELECT o_orderkey, addr, "start", "end" FROM (SELECT p.*, n."start", n."end", row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN n."start" = addr THEN 0 ELSE 1 END, n."end" - n."start", n."start") AS k
FROM p LEFT JOIN nest n ON addr BETWEEN n."start" AND n."end") WHERE k = 1""")
def point_in_interval(spark, d):
    p = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4096).cast("int").alias("addr"))
    return intervals.smallest_containing(p, _nest(spark, d))


@_register(f"""WITH {_NEST}, i AS (SELECT p_partkey, CAST(p_partkey % 4000 AS INT) AS "start", CAST(p_partkey % 4000 + p_size AS INT) AS "end" FROM part)
SELECT p_partkey, i."start", i."end", n."start" AS outer_start, n."end" AS outer_end FROM i JOIN nest n ON n."start" <= i."start" AND i."end" <= n."end" """)
def interval_contains(spark, d):
    i = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4000).cast("int").alias("start"), (F.col("p_partkey") % 4000 + F.col("p_size")).cast("int").alias("end"))
    return intervals.containing_intervals(i, _nest(spark, d)).select("p_partkey", "start", "end", "outer_start", "outer_end")


@_register(f"WITH {_EDGES} SELECT src, dst, edge FROM edges WHERE dst = 17 ORDER BY src, edge LIMIT 100")
def xrefs_to(spark, d):
    return graph.xrefs_to(_edges(spark, d), 17)


@_register(f"WITH {_EDGES} SELECT src, dst, edge FROM edges WHERE src BETWEEN 10 AND 40 ORDER BY src, dst, edge LIMIT 200")
def xrefs_from(spark, d):
    return graph.xrefs_from(_edges(spark, d), 10, 40)


def _refs(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("int").alias("src"), (F.col("l_partkey") + 53248).cast("int").alias("dst"), F.when(F.col("l_returnflag") == "A", "w").when(F.col("l_returnflag") == "R", "rmw").otherwise("r").alias("access"), F.when(F.col("l_linestatus") == "O", "x").alias("index"))


_REFS = "refs AS (SELECT CAST(l_orderkey AS INT) AS src, CAST(l_partkey + 53248 AS INT) AS dst, CASE l_returnflag WHEN 'A' THEN 'w' WHEN 'R' THEN 'rmw' ELSE 'r' END AS access, CASE WHEN l_linestatus = 'O' THEN 'x' END AS \"index\" FROM lineitem)"


@_register(f"WITH {_REFS} SELECT DISTINCT src, dst, access, \"index\" FROM refs WHERE dst = 53255 AND access IN ('w', 'rmw') ORDER BY src, access, \"index\" LIMIT 100")
def writes_to(spark, d):
    return graph.writes_to(_refs(spark, d), 53255)


@_register(f"WITH {_REFS} SELECT DISTINCT src, dst, access FROM refs WHERE dst BETWEEN 53248 AND 53270 ORDER BY dst, src, access LIMIT 300")
def chip_refs(spark, d):
    return graph.hardware_refs(_refs(spark, d), 53248, 53270)


@_register(f"""WITH {_ROUTINES}, {_EDGES}, pick AS (SELECT * FROM routines WHERE "start" % 48 = 0)
SELECT DISTINCT a."start" AS caller, b."start" AS callee FROM edges e JOIN pick a ON e.src BETWEEN a."start" AND a."end" JOIN pick b ON e.dst BETWEEN b."start" AND b."end" WHERE a."start" <> b."start" """)
def induced_edges(spark, d):
    r = _routines(spark, d)
    return graph.induced(r, _edges(spark, d), r.where("start % 48 = 0"))


@_register(f"""WITH {_ROUTINES}, {_EDGES}, n AS (
  SELECT DISTINCT coalesce(a."start", e.src) AS a, a."start" IS NULL AS a_stub, coalesce(b."start", e.dst) AS b, b."start" IS NULL AS b_stub FROM edges e
  LEFT JOIN routines a ON e.src BETWEEN a."start" AND a."end" LEFT JOIN routines b ON e.dst BETWEEN b."start" AND b."end" WHERE coalesce(a."start", e.src) <> coalesce(b."start", e.dst)
), g AS (SELECT a, b, b_stub FROM n UNION SELECT b, a, a_stub FROM n),
h1 AS (SELECT DISTINCT b AS addr, 1 AS hop, b_stub AS stub FROM g WHERE a = 64 ORDER BY addr LIMIT 60),
s1 AS (SELECT * FROM (SELECT 64 AS addr, 0 AS hop, false AS stub UNION ALL SELECT * FROM h1) ORDER BY hop, addr LIMIT 60),
h2 AS (SELECT DISTINCT g.b AS addr, 2 AS hop, g.b_stub AS stub FROM h1 JOIN g ON g.a = h1.addr WHERE NOT h1.stub AND g.b NOT IN (SELECT addr FROM s1) ORDER BY addr LIMIT 60),
s2 AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM h2) ORDER BY hop, addr LIMIT 60)
SELECT addr, hop, stub, r.name FROM s2 LEFT JOIN routines r ON r."start" = addr""")
def n_hop(spark, d):
    nodes, _ = graph.neighbourhood(_routines(spark, d), _edges(spark, d), 64, hops=2)
    return nodes.select("addr", "hop", "stub", "name")


def _snaps(spark, d):
    li = _t(spark, d, "lineitem").withColumn("addr", ((F.col("l_partkey") * 31) % 65536).cast("int"))
    a = li.groupBy("addr").agg(F.min(F.col("l_quantity")).cast("int").alias("b")).withColumn("dump_id", F.lit(1))
    b = li.groupBy("addr").agg((F.max(F.col("l_quantity")) * 5 % 256).cast("int").alias("b")).withColumn("dump_id", F.lit(1))
    return a, b


_REGION = "CASE " + " ".join(f"WHEN addr BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in memdiff.REGIONS) + " ELSE 'unknown' END"
_DIFF = f"""li AS (SELECT CAST((l_partkey * 31) % 65536 AS INT) AS addr, l_quantity FROM lineitem),
ab AS (SELECT addr, CAST(min(l_quantity) AS INT) AS old, CAST(max(l_quantity) * 5 % 256 AS INT) AS new FROM li GROUP BY addr),
diff AS (SELECT 1 AS dump_id, addr, old, new, CAST((new - old + 128 + 512) % 256 - 128 AS INT) AS delta, {_REGION} AS region FROM ab WHERE old <> new)"""


@_register(f"WITH {_DIFF} SELECT * FROM diff WHERE region NOT LIKE 'io\\_%' ESCAPE '\\' ORDER BY addr LIMIT 4096")
def snapshot_diff(spark, d):
    return memdiff.snapshot_diff(*_snaps(spark, d))


@_register(f"WITH {_DIFF} SELECT dump_id, region, count(*) AS n FROM diff GROUP BY ALL")
def region_histogram(spark, d):
    return memdiff.region_histogram(memdiff.snapshot_diff(*_snaps(spark, d), exclude_io=False, most=65536))


@_register(f"""WITH s AS (SELECT CAST(p_partkey % 65536 AS INT) AS addr, unnest(range(4)) AS snap_ix, p_size FROM part), v AS (
  SELECT addr, snap_ix, CAST((300 - snap_ix * (1 + p_size % 3) + p_size) % 256 AS INT) AS b FROM s
), w AS (SELECT *, {_REGION} AS region, (b - lag(b) OVER (PARTITION BY addr ORDER BY snap_ix) + 128 + 512) % 256 - 128 AS d FROM v)
SELECT addr, region, CAST(-1 AS INT) AS delta, array_to_string(list(b ORDER BY snap_ix), ',') AS "values" FROM w WHERE region IN ('zero_page', 'os_workspace', 'low_ram', 'upper_ram', 'screen_ram')
GROUP BY addr, region HAVING count(*) FILTER (d = -1) = 3 AND count(*) = 4""")
def monotonic_scan(spark, d):
    s = _t(spark, d, "part").select(F.lit(1).alias("dump_id"), (F.col("p_partkey") % 65536).cast("int").alias("addr"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("snap_ix"), "p_size")
    s = s.withColumn("b", ((300 - F.col("snap_ix") * (1 + F.col("p_size") % 3) + F.col("p_size")) % 256).cast("int"))
    return memdiff.monotonic_scan(s).select("addr", "region", "delta", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


@_register("""WITH c AS (SELECT DISTINCT user_id % 50 AS source_file, CAST(event_id // 3 AS INT) AS addr FROM events WHERE event_type <> 'view'),
i AS (SELECT *, addr - row_number() OVER (PARTITION BY source_file ORDER BY addr) AS isl FROM c)
SELECT source_file, min(addr) AS "start", max(addr) AS "end", 'code' AS "class" FROM i GROUP BY source_file, isl""")
def rle_runs(spark, d):
    code = _t(spark, d, "events").where("event_type <> 'view'").select((F.col("user_id") % 50).alias("source_file"), F.floor(F.col("event_id") / 3).cast("int").alias("addr"))
    none = spark.createDataFrame([], "source_file long, gap_start int, gap_end int")
    return layer0.classification(code, none)


@_register("""WITH e AS (SELECT user_id % 20 AS k, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id % 20 ORDER BY event_id) > 64 THEN 1 ELSE 0 END AS f FROM events),
c AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY event_id) AS cl FROM e)
SELECT k, min(event_id) AS first_id, count(*) AS n FROM c GROUP BY k, cl HAVING count(*) >= 3""")
def gap_clusters(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 20).alias("k"), "event_id")
    return heuristics.gap_sessions(e, ["k"], "event_id").where("n >= 3").select("k", F.col("begin").alias("first_id"), "n")


@_register("""WITH e AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT a, b, c, count(*) AS n FROM e WHERE c IS NOT NULL GROUP BY ALL""")
def ngram_patterns(spark, d):
    grams = heuristics.following(_t(spark, d, "events"), ["user_id"], "event_id", "event_type")
    return grams.groupBy(*[F.col("gram")[i].alias(c) for i, c in enumerate("abc")]).agg(F.count("*").alias("n"))


_DIM = ", ".join(f"({op}, '{m}', '{mode}', {isa.SIZE[mode]})" for op, (m, mode) in sorted(isa.opcodes().items()))


@_register("SELECT doc_id, CAST(instr(lower(text), 'ing the') - 1 AS INT) AS match_at FROM documents WHERE contains(lower(text), 'ing the') ORDER BY doc_id LIMIT 10")
def text_phrase(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return retrieval.search_text(docs, "ing the", key="doc_id", content="text").where("match_at >= 0").select("doc_id", "match_at")


@_register("""SELECT doc_id, CAST(contains(lower(text), 'token') AS INT) + CAST(contains(lower(text), 'edhathe') AS INT) + CAST(contains(lower(text), 'zzzq') AS INT) AS words FROM documents
WHERE contains(lower(text), 'token') OR contains(lower(text), 'edhathe') OR contains(lower(text), 'zzzq') ORDER BY words DESC, doc_id LIMIT 10""")
def text_ranked(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return retrieval.search_text(docs, "token edhathe zzzq", key="doc_id", content="text").select("doc_id", "words")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@_register(f"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS ws FROM conversations),
u AS (SELECT conv_id, turn, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ws FROM w)
SELECT conv_id, turn, array_to_string(ws[1:8], ' ') AS terms FROM u""")
def term_extract(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.question_terms(F.col("text")), " ").alias("terms"))


def _query_vector(n: int) -> list[float]:
    return [((i * 37) % 11 - 5) / 5 for i in range(n)]


@_register("""WITH q AS (SELECT list_transform(range(64), lambda i: ((i * 37) % 11 - 5) / 5.0::DOUBLE) AS q), s AS (
  SELECT vec_id, list_dot_product(embedding::DOUBLE[], q.q[1:len(embedding)]) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) / sqrt(list_dot_product(q.q[1:len(embedding)], q.q[1:len(embedding)])) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    e = _t(spark, d, "embeddings")
    n = len(e.select("embedding").first()["embedding"])
    return retrieval.vector_search(e, _query_vector(n), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@_register("""WITH q AS (SELECT list_transform(range(64), lambda i: ((i * 37) % 11 - 5) / 5.0::DOUBLE) AS q), s AS (
  SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q.q[1:len(embedding)]) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) / sqrt(list_dot_product(q.q[1:len(embedding)], q.q[1:len(embedding)])) AS c FROM embeddings, q),
top AS (SELECT * FROM s WHERE c >= 0 ORDER BY c DESC, vec_id LIMIT 64), r AS (
  SELECT *, 0.8 * c + 0.2 * (CAST(contains('item ' || vec_id || ' class ' || label, 'class 1') AS INT) + CAST(contains('item ' || vec_id || ' class ' || label, '7') AS INT)) / 2 AS score FROM top)
SELECT vec_id, CAST(label AS INT) AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM r) WHERE n <= 2 ORDER BY score DESC, vec_id LIMIT 8""")
def hybrid_rerank(spark, d):
    e = _t(spark, d, "embeddings").withColumn("text", F.concat(F.lit("item "), F.col("vec_id").cast("string"), F.lit(" class "), F.col("label").cast("string")))
    n = len(e.select("embedding").first()["embedding"])
    out = retrieval.hybrid_rerank(e, _query_vector(n), ["class 1", "7"], key="vec_id", source="label")
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


_USAGE = "usage AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'planner' ELSE 'analyst' END AS role, CASE user_id % 4 WHEN 0 THEN 'alpha-large-2' WHEN 1 THEN 'alpha-small' WHEN 2 THEN 'beta' ELSE 'gamma' END AS model, CAST(user_id AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, value >= 20 AS ok, CASE WHEN event_id % 10 = 0 THEN 'critic' END AS as_role FROM events)"
_PRICES = "prices(prefix, usd_in, usd_out) AS (VALUES ('alpha', 1.0, 2.0), ('alpha-large', 4.0, 8.0), ('beta', 0.5, 0.25))"
_PRICED = """priced AS (SELECT u.*, p.prefix AS price_prefix, coalesce((input_tokens * p.usd_in + output_tokens * p.usd_out) / 1e6, 0.0)::DOUBLE AS cost_usd FROM usage u
LEFT JOIN (SELECT model, max_by(prices, length(prefix)) AS p FROM (SELECT DISTINCT model FROM usage) JOIN prices ON starts_with(model, prefix) GROUP BY model) b USING (model))"""


def _usage(spark, d):
    u, m = F.col("user_id"), F.col("user_id") % 4
    return _t(spark, d, "events").select("event_id", F.when(u % 2 == 0, "planner").otherwise("analyst").alias("role"), F.when(m == 0, "alpha-large-2").when(m == 1, "alpha-small").when(m == 2, "beta").otherwise("gamma").alias("model"), u.alias("input_tokens"), F.floor("value").alias("output_tokens"), (F.col("value") >= 20).alias("ok"), F.when(F.col("event_id") % 10 == 0, "critic").alias("as_role"))


def _priced(spark, d):
    prices = spark.createDataFrame([("alpha", 1.0, 2.0), ("alpha-large", 4.0, 8.0), ("beta", 0.5, 0.25)], "prefix string, usd_in double, usd_out double")
    return ledger.price_calls(_usage(spark, d), prices)


@_register(f"WITH {_USAGE}, {_PRICES}, {_PRICED} SELECT event_id, model, price_prefix, round(cost_usd, 9) AS cost_usd FROM priced")
def longest_prefix_price(spark, d):
    return _priced(spark, d).select("event_id", "model", "price_prefix", F.round("cost_usd", 9).alias("cost_usd"))


@_register(f"""WITH {_USAGE}, {_PRICES}, {_PRICED} SELECT role, model, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (as_role <> role) AS backups, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM priced GROUP BY role, model""")
def usage_by_role(spark, d):
    return ledger.usage_by_role(_priced(spark, d)).withColumn("cost_usd", F.round("cost_usd", 6))


@_register("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 400")
def budget_cutoff(spark, d):
    return retrieval.budgeted(_t(spark, d, "conversations"), 400, ["turn"], "text", ["conv_id"]).select("conv_id", "turn")


@_register("""SELECT conv_id, turn, CASE WHEN role <> 'user' AND row_number() OVER (PARTITION BY conv_id % 7, role <> 'user' ORDER BY conv_id DESC, turn DESC) <= 20 THEN length(text) END AS kept_chars FROM conversations""")
def keep_last_payloads(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 7).alias("run_id"), F.struct("conv_id", "turn").alias("result_pos"), F.when(F.col("role") != "user", F.col("text")).alias("data"))
    return ledger.bound_payloads(c, most=20).select("conv_id", "turn", F.length("data").alias("kept_chars"))


_CHAIN = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS plan_id, o_orderkey AS k, 's' || o_orderkey AS step_id, 's' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 5 AS p FROM orders),
dep AS (SELECT plan_id, step_id, k, prev AS dep, CASE p WHEN 0 THEN 'satisfied' WHEN 1 THEN 'exhausted' WHEN 4 THEN 'inconclusive' ELSE 'pending' END AS state FROM o WHERE prev IS NOT NULL UNION ALL SELECT plan_id, step_id, k, 'gone' || k, 'missing' FROM o WHERE k % 11 = 0)"""


def _plan(spark, d):
    """Orders as steps of their customer's plan: each depends on the one before, some on a step that isn't there; by key they have succeeded, failed twice or once, not been tried, or ended without a result."""
    k = F.col("o_orderkey")
    before = F.lag(k).over(Window.partitionBy("o_custkey").orderBy(k))
    deps = F.array_compact(F.array(F.concat(F.lit("s"), before.cast("string")), F.when(k % 11 == 0, F.concat(F.lit("gone"), k.cast("string")))))
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("plan_id"), F.concat(F.lit("s"), k.cast("string")).alias("step_id"), k, deps.alias("depends_on"))
    steps = o.select("plan_id", "step_id", k.alias("pos"), F.lit("kb").alias("tool"), F.lit("{}").alias("args"), "depends_on")
    tries = F.when(k % 5 == 1, F.array(F.lit(0), F.lit(1))).when(k % 5 == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    results = o.select("plan_id", "step_id", k, F.explode(tries).alias("n"))
    outcome = F.when(k % 5 == 4, "inconclusive").when(k % 5 == 0, "done").otherwise("timeout")
    return steps, results.select("plan_id", "step_id", (k * 2 + F.col("n")).alias("result_pos"), (k % 5 == 0).alias("ok"), F.lit(True).alias("retryable"), F.lit(None).cast("string").alias("rejection"), outcome.alias("outcome"))


@_register(f"""WITH {_CHAIN}, ready AS (SELECT plan_id, step_id, k, CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END::BIGINT AS fails FROM o WHERE k % 5 IN (2, 3) AND NOT EXISTS (SELECT 1 FROM dep WHERE dep.plan_id = o.plan_id AND dep.step_id = o.step_id AND state <> 'satisfied'))
SELECT plan_id, step_id, fails, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY fails, k) AS INT) AS turn FROM ready""")
def runnable_steps(spark, d):
    return ledger.runnable(*_plan(spark, d)).select("plan_id", "step_id", "fails", "turn")


@_register(f"WITH {_CHAIN} SELECT plan_id, step_id, dep, 'dependency ' || dep || ' is ' || state AS reason FROM dep WHERE k % 5 IN (2, 3) AND state <> 'satisfied'")
def blocked_steps(spark, d):
    return ledger.blocked(*_plan(spark, d))


@_register("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def turn_rating_join(spark, d):
    turns = _t(spark, d, "documents").select(F.col("doc_id").alias("run_id"), "lang")
    ratings = _t(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.col("quality").alias("rating"), F.col("toxic").alias("comment"), F.lit(1).alias("revision"))
    return ledger.latest_ratings(turns, ratings).select(F.col("run_id").alias("doc_id"), "lang", F.col("rating").alias("quality"), F.col("comment").alias("toxic"))


@_register("""WITH t AS (SELECT l_suppkey % 10 AS trace_id, l_orderkey * 8 + l_linenumber AS line_no, CAST(l_partkey AS INT) AS addr, CAST(1 + l_linenumber % 3 AS INT) AS n_bytes FROM lineitem),
o AS (SELECT trace_id, addr, min(line_no) AS line_no, arg_min(n_bytes, line_no) AS n_bytes FROM t GROUP BY ALL), c AS (SELECT trace_id, addr AS outer_addr, unnest(range(addr + 1, addr + n_bytes)) AS addr FROM o),
p AS (SELECT c.trace_id, c.outer_addr, c.addr FROM c JOIN o ON c.trace_id = o.trace_id AND c.addr = o.addr)
SELECT o.trace_id, o.addr, o.line_no, o.n_bytes, (SELECT count(*) FROM p WHERE p.trace_id = o.trace_id AND p.addr = o.addr) AS n_inside, (SELECT count(*) FROM p WHERE p.trace_id = o.trace_id AND p.outer_addr = o.addr) AS n_contains FROM o""")
def trace_reduction(spark, d):
    t = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("trace_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), F.col("l_partkey").cast("int").alias("addr"), (1 + F.col("l_linenumber") % 3).cast("int").alias("n_bytes"), F.lit("nop").alias("mnemonic"), F.lit("").alias("operand"))
    n = lambda c: F.size(F.coalesce(c, F.array().cast("array<int>"))).cast("long")
    return heuristics.reduce_trace(t).select("trace_id", "addr", "line_no", "n_bytes", n(F.col("inside_of")).alias("n_inside"), n(F.col("contains")).alias("n_contains"))


@_register("""WITH c AS (SELECT CAST(s_suppkey % 40 * 16 AS INT) AS addr, regexp_replace(trim(s_name), '[^A-Za-z0-9_]', '_', 'g') AS symbol, s_acctbal / 10000 AS confidence, s_suppkey AS ord FROM supplier)
SELECT addr, symbol, confidence FROM (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY confidence DESC, ord) AS n FROM c WHERE confidence >= 0.3) WHERE n = 1""")
def symbol_export(spark, d):
    s = _t(spark, d, "supplier").select((F.col("s_suppkey") % 40 * 16).cast("int").alias("addr"), F.col("s_name").alias("name"), (F.col("s_acctbal") / 10000).alias("confidence"), F.array().cast("array<string>").alias("flags"), F.col("s_suppkey").alias("ord"))
    return sinks.symbols(s, 0.3)


@_register("""WITH l AS (SELECT o_custkey, max_by(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS h FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN h IS NULL THEN 'new' WHEN h % 2 = c_custkey % 2 THEN 'current' ELSE 'changed' END AS state FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def freshness_state(spark, d):
    f = _t(spark, d, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 2).cast("string").alias("sha256"), F.lit(0).alias("size"), F.lit(0).alias("mtime"))
    i = _t(spark, d, "orders").select(F.col("o_custkey").alias("path"), (F.floor("o_totalprice") % 2).cast("string").alias("sha256"), F.lit(0).alias("size"), F.lit(0).alias("mtime"), F.col("o_orderkey").alias("log_pos"))
    return files.freshness(f, i).select(F.col("path").alias("c_custkey"), "state")


@_register("""WITH t AS (SELECT p_partkey, '$' || printf('%04X', p_partkey % 65536) || ' and 0x' || lower(printf('%04X', (p_partkey * 7) % 65536)) || ' then $' || printf('%04X', p_partkey % 65536) AS s FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 65536 = (p_partkey * 7) % 65536 THEN CAST(p_partkey % 65536 AS VARCHAR) ELSE CAST(p_partkey % 65536 AS VARCHAR) || ',' || CAST((p_partkey * 7) % 65536 AS VARCHAR) END AS addrs FROM t""")
def address_extract(spark, d):
    hx = lambda c: F.lpad(F.hex(c % 65536), 4, "0")
    s = F.concat(F.lit("$"), hx(F.col("p_partkey")), F.lit(" and 0x"), F.lower(hx(F.col("p_partkey") * 7)), F.lit(" then $"), hx(F.col("p_partkey")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(T.hex_addresses(s).cast("array<string>"), ",").alias("addrs"))


@_register("""WITH v AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'replan' WHEN turn % 3 = 0 THEN 'accept' ELSE 'replan' END AS d FROM conversations),
w AS (SELECT *, lag(d) OVER (PARTITION BY conv_id ORDER BY turn) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM v)
SELECT conv_id AS run_id, d = 'replan' AND coalesce(b = 'replan', false) AS dead_end FROM w WHERE n = 1""")
def dead_ends(spark, d):
    v = _t(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "replan").when(F.col("turn") % 3 == 0, "accept").otherwise("replan").alias("decision"))
    return ledger.two_replans(v)


@_register()
def redaction(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@_register()
def chunks(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))


@_register()
def name_promotion(spark, d):
    r = _routines(spark, d).select(F.col("start").alias("start_addr"), (F.col("start") % 977).cast("long").alias("log_pos"), F.concat(F.lit("r"), F.col("start").cast("string")).alias("id"), "name", F.lit(0.55).alias("confidence"))
    h = _hypotheses(spark, d).select(F.col("start").alias("start_addr"), F.col("id").alias("log_pos"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("id"), F.col("name").alias("suggested_name"), "confidence")
    return fold.promote_names(r, h)


from petrel.plans import catalog  # noqa: E402, F401  (registers its queries here)
from petrel.plans import lookups  # noqa: E402, F401
from petrel.plans import asked, dumps, listings  # noqa: E402, F401

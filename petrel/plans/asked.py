"""Registered queries: the stores' modes by name, over views made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrel.plans import surface
from petrel.plans.registry import _EDGES, _ROUTINES, _edges, _register, _routines, _t

_REFS = "refs AS (SELECT CAST(l_partkey AS INT) AS src_addr, CAST(53248 + l_suppkey * 7 AS INT) AS dst_addr, CASE l_linenumber % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'w' ELSE 'rmw' END AS access, CASE WHEN l_linestatus = 'F' THEN 'x' END AS index_reg, l_linenumber = 7 AS indirect FROM lineitem)"
_HYP = "hyp AS (SELECT event_id::VARCHAR AS annotation_id, CAST(event_id % 3 + 1 AS INT) AS layer, CAST(user_id * 16 AS INT) AS start_addr, CAST(user_id * 16 + 15 AS INT) AS end_addr, event_type AS \"text\", 'hyp_' || event_type AS name_suggestion, value / 100 AS confidence, 'm' AS producer, '[]' AS flags_json FROM events)"
_CODE = "code AS (SELECT CAST(p_partkey AS INT) AS addr, CASE p_size % 3 WHEN 0 THEN 'lda' WHEN 1 THEN 'sta' ELSE 'jmp' END AS mnemonic, '$' || printf('%04X', p_size * 16) AS operand FROM part)"


def _views(spark, d):
    li, e, p, s = (_t(spark, d, t) for t in ("lineitem", "events", "part", "supplier"))
    access = F.when(F.col("l_linenumber") % 3 == 0, "r").when(F.col("l_linenumber") % 3 == 1, "w").otherwise("rmw")
    layer = (F.col("event_id") % 3 + 1).cast("int")
    start = (F.col("user_id") * 16).cast("int")
    return {
        "code_routines": _routines(spark, d).withColumnsRenamed({"start": "start_addr", "end": "end_addr"}), "code_xrefs": _edges(spark, d).withColumnsRenamed({"src": "src_addr", "dst": "dst_addr", "edge": "kind"}),
        "code_data_refs": li.select(F.col("l_partkey").cast("int").alias("src_addr"), (53248 + F.col("l_suppkey") * 7).cast("int").alias("dst_addr"), access.alias("access"), F.when(F.col("l_linestatus") == "F", "x").alias("index_reg"), (F.col("l_linenumber") == 7).alias("indirect")),
        "code_smc_sites": li.where("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_orderkey").cast("int").alias("src_addr"), F.col("l_partkey").cast("int").alias("dst_addr"), F.col("l_linestatus").alias("smc_kind")),
        "hypotheses": e.select(F.col("event_id").cast("string").alias("annotation_id"), layer.alias("layer"), start.alias("start_addr"), (start + 15).alias("end_addr"), F.col("event_type").alias("text"), F.concat(F.lit("hyp_"), "event_type").alias("name_suggestion"), (F.col("value") / 100).alias("confidence"), F.lit("m").alias("producer"), F.lit("[]").alias("flags_json")),
        "annotations": e.select(F.col("event_id").cast("string").alias("id"), layer.alias("layer"), F.when(F.col("event_type") == "click", "critique").otherwise("note").alias("kind"), start.alias("start_addr"), (start + 15).alias("end_addr"), F.lit("m").alias("producer"), (F.col("value") / 100).alias("confidence"), F.concat(F.lit('{"verdict": "v'), "user_id", F.lit('"}')).alias("payload_json"), F.lit("[]").alias("evidence_json"), F.lit("[]").alias("flags_json"), F.col("event_id").alias("seq")),
        "instructions": p.select(F.col("p_partkey").cast("int").alias("addr"), F.when(F.col("p_size") % 3 == 0, "lda").when(F.col("p_size") % 3 == 1, "sta").otherwise("jmp").alias("mnemonic"), F.concat(F.lit("$"), F.lpad(F.hex(F.col("p_size") * 16), 4, "0")).alias("operand")),
        "code_labels": s.select((F.col("s_suppkey") * 16).cast("int").alias("addr"), F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("name")),
        "asm_docs": _t(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content")),
        "labels": s.select((F.col("s_suppkey") * 16).cast("int").alias("addr"), F.col("s_name").alias("name"), F.lit("code").alias("kind"), (F.col("s_suppkey") % 10 / 10).alias("confidence")),
        "events": e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("props").alias("payload_json")),
    }


def _ask(spark, d, mode, store="code_kb", **args):
    return surface.ask(store, mode, _views(spark, d), **args)


@_register(f"WITH {_EDGES} SELECT DISTINCT src AS src_addr, edge AS kind FROM edges WHERE dst = 82 ORDER BY src_addr, kind LIMIT 100")
def mode_xrefs_to(spark, d):
    return _ask(spark, d, "xrefs_to", addr=82)


@_register(f"WITH {_EDGES} SELECT DISTINCT src AS src_addr, dst AS dst_addr, edge AS kind FROM edges WHERE src BETWEEN 16 AND 79 ORDER BY src_addr, dst_addr, kind LIMIT 200")
def mode_xrefs_from(spark, d):
    return _ask(spark, d, "xrefs_from", start="$0010", end="$004F")


@_register(f'WITH {_ROUTINES} SELECT "start" AS start_addr, "end" AS end_addr, name FROM routines WHERE 93 BETWEEN "start" AND "end" ORDER BY "end" - "start", "start" LIMIT 1')
def mode_routine(spark, d):
    return _ask(spark, d, "routine", start=93)


@_register(f"""WITH {_ROUTINES}, {_EDGES}, {_HYP}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_addr ORDER BY confidence DESC, annotation_id DESC) AS rn FROM hyp WHERE layer = 1) WHERE rn = 1),
c AS (SELECT r."start", count(DISTINCT e.src) AS callers FROM routines r LEFT JOIN edges e ON e.dst BETWEEN r."start" AND r."end" GROUP BY 1)
SELECT r."start", r."end", CASE WHEN r.name <> '' AND r.name NOT LIKE 'sub_%' THEN r.name ELSE coalesce(b.name_suggestion, r.name) END AS display_name, callers, confidence
FROM routines r JOIN c USING ("start") LEFT JOIN best b ON b.start_addr = r."start" ORDER BY callers DESC, "start" LIMIT 40""")
def mode_routines(spark, d):
    return _ask(spark, d, "routines", limit=40)


@_register("SELECT CAST(l_orderkey AS INT) AS src_addr, CAST(l_partkey AS INT) AS dst_addr, l_linestatus AS smc_kind FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 ORDER BY 1, 2 LIMIT 100")
def mode_smc(spark, d):
    return _ask(spark, d, "smc")


@_register(f"WITH {_REFS} SELECT DISTINCT src_addr, access, index_reg, indirect FROM refs WHERE dst_addr = 53283 AND access IN ('w', 'rmw') ORDER BY src_addr, access, index_reg NULLS FIRST, indirect LIMIT 100")
def mode_writes_to(spark, d):
    return _ask(spark, d, "writes_to", addr="$D023")


@_register(f"WITH {_REFS} SELECT DISTINCT src_addr, access, index_reg, indirect FROM refs WHERE dst_addr = 53283 ORDER BY src_addr, access, index_reg NULLS FIRST, indirect LIMIT 200")
def mode_refs_to(spark, d):
    return _ask(spark, d, "refs_to", target=53283)


@_register(f"WITH {_REFS} SELECT DISTINCT src_addr, dst_addr, access, index_reg FROM refs WHERE dst_addr BETWEEN 53248 AND 57343 ORDER BY dst_addr, src_addr, access, index_reg NULLS FIRST LIMIT 300")
def mode_hardware_refs(spark, d):
    return _ask(spark, d, "hardware_refs")


@_register(f'WITH {_HYP} SELECT annotation_id, start_addr, end_addr, "text", name_suggestion, confidence, producer, flags_json FROM hyp WHERE layer = 2 ORDER BY confidence DESC, start_addr, annotation_id LIMIT 50')
def mode_groups(spark, d):
    return _ask(spark, d, "groups")


@_register("""SELECT event_id::VARCHAR AS id, CAST(user_id * 16 AS INT) AS start_addr, CAST(user_id * 16 + 15 AS INT) AS end_addr, 'm' AS producer, value / 100 AS confidence, '[]' AS evidence_json, '[]' AS flags_json, event_id AS seq,
'v' || user_id::VARCHAR AS verdict, NULL::VARCHAR AS summary, NULL::VARCHAR AS target FROM events WHERE event_type = 'click' AND event_id % 3 = 2 ORDER BY event_id DESC LIMIT 50""")
def mode_critiques(spark, d):
    return _ask(spark, d, "critiques")


@_register("""SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, CAST(instr(lower(text), 'ing the') - 1 AS INT) AS match_at FROM documents WHERE contains(lower(text), 'ing the') ORDER BY path LIMIT 10""")
def mode_search(spark, d):
    return _ask(spark, d, "search", q="ING the").select("path", "match_at")


@_register(f"WITH {_CODE} SELECT * FROM code WHERE addr >= 100 ORDER BY addr LIMIT 32")
def mode_disasm(spark, d):
    return _ask(spark, d, "disasm", start=100)


@_register(f"""WITH {_CODE}, l AS (SELECT CAST(s_suppkey * 16 AS INT) AS addr, 'L' || s_suppkey::VARCHAR AS name FROM supplier)
SELECT c.addr, CASE WHEN n.name IS NOT NULL THEN n.name || ':' END AS label, rtrim('$' || printf('%04X', c.addr) || '  ' || upper(mnemonic) || ' ' || coalesce(t.name, operand)) AS line
FROM code c LEFT JOIN l t ON '$' || printf('%04X', t.addr) = operand LEFT JOIN l n ON n.addr = c.addr""")
def mode_export(spark, d):
    return _ask(spark, d, "export")


@_register("SELECT event_id::VARCHAR AS id, event_type AS kind, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, props AS payload_json FROM events WHERE event_type = 'click' ORDER BY ts DESC, id DESC LIMIT 50")
def mode_events(spark, d):
    return _ask(spark, d, "events", "kb", kind="click")


@_register(f"""WITH {_ROUTINES}, {_EDGES} SELECT 'code_xrefs' AS "view", count(*) AS n FROM edges UNION ALL SELECT 'code_routines', count(*) FROM routines UNION ALL SELECT 'code_data_refs', count(*) FROM lineitem
UNION ALL SELECT 'code_smc_sites', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 UNION ALL SELECT unnest(['hypotheses', 'annotations', 'events']), count(*) FROM events GROUP BY 1
UNION ALL SELECT 'instructions', count(*) FROM part UNION ALL SELECT unnest(['code_labels', 'labels']), count(*) FROM supplier GROUP BY 1 UNION ALL SELECT 'asm_docs', count(*) FROM documents""")
def mode_stats(spark, d):
    return _ask(spark, d, "stats")


@_register(f"""WITH {_REFS} SELECT access, count(*) AS n, count(DISTINCT src_addr) AS sources FROM refs WHERE dst_addr > 53248 GROUP BY access ORDER BY access""")
def mode_sql(spark, d):
    """A statement with names and a literal that the surface repairs."""
    return _ask(spark, d, "sql", sql="SELECT access, count(*) AS n, count(DISTINCT src_addr) AS sources FROM code_data_refs WHERE dst_addr > 0xD000 GROUP BY access ORDER BY access;")

"""Registered queries over text that the parsers read: listings, traces and monitor rows made of line items, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrel.functions import text as T
from petrel.operators import layer0
from petrel.plans.registry import _register, _t
from petrel.sources import files

_ROWS = """li AS (SELECT 'f' || (l_suppkey % 20)::VARCHAR AS source_file, l_orderkey * 8 + l_linenumber AS line_no, CAST(l_partkey % 65536 AS INT) AS addr, CAST(l_suppkey % 256 AS INT) AS lo, CAST(l_orderkey % 256 AS INT) AS hi,
CAST(l_orderkey % 7 AS INT) AS kind, l_orderkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"""


def _rows(spark, d):
    """A line number, an address, two bytes and a kind per line of an order."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    low, high = (F.col(c) % 256 for c in ("l_suppkey", "l_orderkey"))
    return li.select(F.concat(F.lit("f"), (F.col("l_suppkey") % 20).cast("string")).alias("source_file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), (F.col("l_partkey") % 65536).cast("int").alias("addr"),
                     low.cast("int").alias("lo"), high.cast("int").alias("hi"), (F.col("l_orderkey") % 7).cast("int").alias("kind"), "l_orderkey")


def _hex(c, n):
    return T.hex_digits(F.col(c) if isinstance(c, str) else c, n)


def _listing(spark, d):
    """Kinds 0 to 3 are instructions in four spellings, 4 a label, 5 a gap comment, 6 blank or what no parser takes."""
    r = _rows(spark, d)
    a, lo, hi = _hex("addr", 4), _hex("lo", 2), _hex("hi", 2)
    text = F.when(F.col("kind") == 0, F.concat(F.lit("  $"), a, F.lit(":  8D "), lo, F.lit(" "), hi, F.lit("  STA $"), hi, lo, F.lit("  ; note")))
    text = text.when(F.col("kind") == 1, F.concat(F.lower(a), F.lit(" a9 "), F.lower(lo), F.lit("  lda #0x"), F.lower(lo)))
    text = text.when(F.col("kind") == 2, F.concat(F.lit("$"), a, F.lit("  20 "), lo, F.lit(" "), hi, F.lit("  jsr Name"), (F.col("l_orderkey") % 50).cast("string")))
    text = text.when(F.col("kind") == 3, F.concat(a, F.lit(": 60  rts")))
    text = text.when(F.col("kind") == 4, F.concat(F.lit("Name"), (F.col("l_orderkey") % 50).cast("string"), F.lit(":  ; here")))
    text = text.when(F.col("kind") == 5, F.concat(F.lit("; gap $"), a, F.lit("-$"), _hex(F.when(F.col("lo") % 2 == 0, F.col("addr") + F.col("lo")).otherwise(F.greatest(F.col("addr") - F.col("lo"), F.lit(0))), 4)))
    return r.select("source_file", "line_no", text.otherwise(F.when(F.col("lo") % 2 == 0, "  ").otherwise("no listing line")).alias("line"))


_PARSED = f"""{_ROWS}, code AS (SELECT source_file, line_no, addr, CASE kind WHEN 0 THEN '8D ' || printf('%02X %02X', lo, hi) WHEN 1 THEN 'A9 ' || printf('%02X', lo) WHEN 2 THEN '20 ' || printf('%02X %02X', lo, hi) ELSE '60' END AS bytes_hex,
CASE kind WHEN 0 THEN 'sta' WHEN 1 THEN 'lda' WHEN 2 THEN 'jsr' ELSE 'rts' END AS mnemonic,
CASE kind WHEN 0 THEN '$' || printf('%02X%02X', hi, lo) WHEN 1 THEN '#$' || printf('%02X', lo) WHEN 2 THEN 'Name' || (l_orderkey % 50)::VARCHAR ELSE '' END AS operand, CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INT) AS size FROM li WHERE kind < 4)"""
_NAMED = f"""{_PARSED}, around AS (SELECT *, CASE WHEN kind < 4 THEN addr END AS own, first_value(own IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt,
  last_value(own IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv FROM li),
named AS (SELECT source_file, coalesce(nxt, prv) AS addr, 'Name' || (l_orderkey % 50)::VARCHAR AS name, line_no AS ord FROM around WHERE kind = 4 AND coalesce(nxt, prv) IS NOT NULL)"""


@_register(f"WITH {_PARSED} SELECT * FROM code")
def listing_instructions(spark, d):
    return files.parse_listing(_listing(spark, d))["instructions"].select("source_file", "line_no", "addr", "bytes_hex", "mnemonic", "operand", "size")


@_register(f"WITH {_NAMED} SELECT * FROM named")
def listing_labels(spark, d):
    return files.parse_listing(_listing(spark, d))["labels"].select("source_file", "addr", "name", "ord")


@_register(f"""WITH {_ROWS}, g AS (SELECT source_file, count(*) AS gaps FROM li WHERE kind = 5 AND (lo % 2 = 0 OR addr = 0) GROUP BY ALL)
SELECT source_file, count(*) AS total_lines, count_if(kind = 6 AND lo % 2 = 1)::BIGINT AS skipped_lines, coalesce(any_value(gaps), 0) AS gaps FROM li LEFT JOIN g USING (source_file) GROUP BY ALL""")
def listing_counters(spark, d):
    found = files.parse_listing(_listing(spark, d))
    gaps = found["gaps"].groupBy("source_file").agg(F.count("*").alias("gaps"))
    return found["counters"].join(gaps, "source_file", "left").select("source_file", "total_lines", "skipped_lines", F.coalesce("gaps", F.lit(0)).alias("gaps"))


@_register(f"""WITH {_NAMED}, sym AS (SELECT source_file, name, arg_min(addr, ord) AS addr FROM named GROUP BY ALL)
SELECT DISTINCT c.source_file, c.addr AS src, s.addr AS dst FROM code c JOIN sym s ON s.source_file = c.source_file AND s.name = c.operand WHERE c.mnemonic = 'jsr'""")
def listing_calls(spark, d):
    """Calls by name, resolved to the name's first address in the file."""
    found = files.parse_listing(_listing(spark, d))
    edges = layer0.xrefs(found["instructions"], found["labels"])
    return edges.where("edge = 'jsr' and dst is not null").select("source_file", "src", "dst").distinct()


@_register(f"""WITH {_PARSED}, l AS (SELECT source_file, addr, kind, lo, l_orderkey FROM li WHERE kind < 4)
SELECT source_file, addr, CASE kind WHEN 0 THEN 'D' WHEN 1 THEN 'a9' WHEN 2 THEN CASE WHEN lo >= 160 THEN printf('%02X', lo) WHEN lo % 16 >= 10 THEN printf('%X', lo % 16) ELSE 'x' END ELSE 'rts' END AS name FROM l WHERE kind <> 2""")
def listing_first_names(spark, d):
    """The first identifier after the address, which is a mnemonic or a byte pair that starts with a letter."""
    r = _listing(spark, d).where(~F.col("line").contains("jsr") & ~F.col("line").startswith("no ") & ~F.col("line").startswith("Name"))
    return files.listing_names(r).select("source_file", "addr", "name")


@_register(f"""WITH {_ROWS} SELECT source_file AS trace_id, line_no, addr, CAST(1 + lo % 3 AS INT) AS n_bytes, 'lda' AS mnemonic, CASE WHEN hi % 2 = 0 THEN '$' || printf('%02X', hi) || ',X' ELSE '($' || printf('%02X', lo) || '), Y' END AS operand FROM li WHERE kind <> 6""")
def trace_parsed(spark, d):
    """Execution traces: bytes up to the mnemonic, the operand up to the registers."""
    r = _rows(spark, d)
    n = F.col("lo") % 3
    raw = F.concat_ws(" ", _hex("lo", 2), F.when(n > 0, _hex("hi", 2)), F.when(n > 1, F.lit("00")))
    op = F.when(F.col("hi") % 2 == 0, F.concat(F.lit("$"), _hex("hi", 2), F.lit(",X"))).otherwise(F.concat(F.lit("($"), _hex("lo", 2), F.lit("), Y")))
    line = F.concat(F.when(F.col("kind") == 6, F.lit("#")).otherwise(F.lit(".C:")), F.lower(_hex("addr", 4)), F.lit("  "), raw, F.lit("   LDA "), op, F.lit("   - A:00 X:01 SP:f6"))
    return files.trace_rows(r.select(F.col("source_file").alias("trace_id"), "line_no", line.alias("line")))


@_register(f"""WITH {_ROWS} SELECT source_file, line_no, addr, printf('%02X %02X', lo, hi) AS bytes_hex, 'bne' AS mnemonic, '$' || printf('%04X', addr) AS operand FROM li WHERE kind <> 6""")
def monitor_parsed(spark, d):
    """Rows of a monitor, with and without its prompt."""
    r = _rows(spark, d)
    head = F.when(F.col("kind") == 6, "?").when(F.col("kind") % 3 == 0, ".C:").when(F.col("kind") % 3 == 1, ".").otherwise("  $")
    line = F.concat(head, F.lower(_hex("addr", 4)), F.lit("  "), F.lower(_hex("lo", 2)), F.lit(" "), F.lower(_hex("hi", 2)), F.lit("     BNE $"), _hex("addr", 4), F.lit("   - note"))
    return files.monitor_rows(r.select("source_file", "line_no", line.alias("line")))

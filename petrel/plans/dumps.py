"""Registered queries over images: the bytes of ``documents``, 64 KiB of a text to an image, each byte shifted by its place so that all opcodes occur."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from petrel.operators import decode, heuristics, memdiff
from petrel.plans.registry import _DIM, _register, _t

_CELLS = """doc AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents), place AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM doc),
cells AS MATERIALIZED (SELECT doc_id::VARCHAR || ':' || (i // 65536)::VARCHAR AS dump_id, CAST(i % 65536 AS INT) AS addr, CAST((('0x' || substr(h, 2 * i + 1, 2))::INT * 7 + i % 65536 * 13 + 5) % 256 AS INT) AS b FROM place)"""
_CODE = f"""dim(opcode, mnemonic, mode, size) AS (VALUES {_DIM}), {_CELLS},
l AS (SELECT *, lead(b) OVER w AS b1, lead(b, 2) OVER w AS b2 FROM cells WINDOW w AS (PARTITION BY dump_id ORDER BY addr)),
code AS MATERIALIZED (SELECT dump_id, addr, b1, b2, mnemonic, mode, size, CAST(addr + size AS INT) AS next_addr FROM l JOIN dim ON b = opcode WHERE size = 1 OR (size = 2 AND b1 IS NOT NULL) OR b2 IS NOT NULL)"""


def _dumps(spark, d):
    """``dump_id, content`` of whole texts: a long one is several images."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    docs = _t(spark, d, "documents").select("doc_id", raw.alias("raw")).where(F.length("raw") > 0)
    part = F.explode(F.sequence(F.lit(0), F.floor((F.length("raw") - 1) / decode.IMAGE).cast("int"))).alias("k")
    docs = docs.select("doc_id", "raw", part)
    return docs.select(F.concat_ws(":", "doc_id", "k").alias("dump_id"), F.substring("raw", F.col("k") * decode.IMAGE + 1, F.lit(decode.IMAGE)).alias("content"))


@F.pandas_udf(BinaryType())
def _shifted(content: pd.Series) -> pd.Series:
    def shift(raw: bytes) -> bytes:
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        return ((b * 7 + np.arange(len(b)) * 13 + 5) % 256).astype(np.uint8).tobytes()

    return content.map(shift)


def _shifted_images(spark, d):
    return decode.images(_dumps(spark, d)).withColumn("content", _shifted("content"))


def _code(spark, d):
    return decode.decode_images(_shifted_images(spark, d))


@_register(f"WITH {_CODE} SELECT dump_id, mnemonic, mode, count(*) AS n, sum(addr)::BIGINT AS addrs, sum(next_addr)::BIGINT AS ends FROM code GROUP BY ALL")
def opcode_decode(spark, d):
    """Every offset of every image decoded; sums per image, mnemonic and mode."""
    return _code(spark, d).groupBy("dump_id", "mnemonic", "mode").agg(F.count("*").alias("n"), F.sum("addr").alias("addrs"), F.sum("next_addr").alias("ends"))


_REFS = f"""{_CODE}, refs AS (SELECT dump_id, addr AS src, CASE WHEN size = 3 THEN b1 + 256 * b2 ELSE b1 END AS dst,
  CASE WHEN mnemonic IN ('sta', 'stx', 'sty') THEN 'w' WHEN mnemonic IN ('inc', 'dec', 'asl', 'lsr', 'rol', 'ror') THEN 'rmw' ELSE 'r' END AS access,
  CASE WHEN mode IN ('absx', 'zpx', 'indx') THEN 'x' WHEN mode IN ('absy', 'zpy', 'indy') THEN 'y' END AS "index", mode IN ('indx', 'indy', 'ind') AS indirect FROM code
  WHERE mnemonic IN ('sta', 'stx', 'sty', 'inc', 'dec', 'asl', 'lsr', 'rol', 'ror', 'lda', 'ldx', 'ldy', 'cmp', 'cpx', 'cpy', 'bit', 'and', 'ora', 'eor', 'adc', 'sbc') AND mode NOT IN ('imm', 'acc'))"""


@_register(f'WITH {_REFS} SELECT dump_id, access, "index", indirect, count(*) AS n, sum(src)::BIGINT AS srcs, sum(dst)::BIGINT AS dsts FROM refs GROUP BY ALL')
def data_refs(spark, d):
    return heuristics.data_refs(_code(spark, d)).groupBy("dump_id", "access", "index", "indirect").agg(F.count("*").alias("n"), F.sum("src").alias("srcs"), F.sum("dst").alias("dsts"))


@_register(f"""WITH RECURSIVE {_CODE}, walk AS (SELECT dump_id, 0 AS ord, addr, mnemonic, next_addr FROM code WHERE addr = 0
UNION ALL SELECT c.dump_id, ord + 1, c.addr, c.mnemonic, c.next_addr FROM walk w JOIN code c ON c.dump_id = w.dump_id AND c.addr = w.next_addr WHERE ord < 199)
SELECT dump_id, CAST(ord AS INT) AS ord, addr, mnemonic FROM walk""")
def linear_listing(spark, d):
    return decode.linear_images(_shifted_images(spark, d), 0, 200).select("dump_id", "ord", "addr", "mnemonic")


@_register(f"""WITH RECURSIVE {_CODE}, step AS MATERIALIZED (
  SELECT dump_id, addr, next_addr AS dst FROM code WHERE mnemonic NOT IN ('rts', 'rti', 'brk', 'jmp')
  UNION ALL SELECT dump_id, addr, CASE WHEN mode = 'rel' THEN (addr + 2 + (b1 + 128) % 256 - 128 + 65536) % 65536 WHEN mode = 'abs' THEN b1 + 256 * b2 END FROM code WHERE mode = 'rel' OR (mnemonic IN ('jsr', 'jmp') AND mode = 'abs')
  UNION ALL SELECT c.dump_id, c.addr, nullif(lo.b + 256 * hi.b, 0) FROM code c JOIN cells lo ON lo.dump_id = c.dump_id AND lo.addr = c.b1 + 256 * c.b2 JOIN cells hi ON hi.dump_id = c.dump_id AND hi.addr = lo.addr + 1 WHERE c.mode = 'ind'
), seen AS (SELECT dump_id, addr FROM code WHERE addr = 0 UNION SELECT c.dump_id, c.addr FROM seen s JOIN step t ON t.dump_id = s.dump_id AND t.addr = s.addr JOIN code c ON c.dump_id = t.dump_id AND c.addr = t.dst)
SELECT dump_id, count(*) AS n, sum(addr)::BIGINT AS addrs FROM seen GROUP BY ALL""")
def recursive_listing(spark, d):
    """What is reached from the first byte of every image, over calls, jumps and branches."""
    entries = _dumps(spark, d).select("dump_id", F.lit(0).alias("entry"))
    code = decode.recursive_images(_shifted_images(spark, d), entries, most=decode.IMAGE, vectors_too=False)
    return code.groupBy("dump_id").agg(F.count("*").alias("n"), F.sum("addr").alias("addrs"))


@_register(f"""WITH {_CODE}, s AS (SELECT c.*, CASE WHEN mode IN ('absx', 'absy', 'abs') THEN b1 + 256 * b2 WHEN mode IN ('zp', 'zpx', 'zpy') THEN b1 END AS target FROM code c WHERE mnemonic IN ('sta', 'stx', 'sty')),
k AS (SELECT s.*, CASE WHEN t.addr IS NOT NULL AND s.target > 255 THEN 'absolute_into_code' WHEN s.mode IN ('absx', 'absy') AND s.target BETWEEN 2048 AND 53247 THEN 'indexed_into_program_ram' END AS kind
  FROM s LEFT JOIN code t ON t.dump_id = s.dump_id AND t.addr = s.target)
SELECT dump_id, kind, mnemonic, count(*) AS n, sum(addr)::BIGINT AS sites, sum(target)::BIGINT AS targets FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def stores_into_code(spark, d):
    return heuristics.self_modifying(_code(spark, d)).groupBy("dump_id", "kind", "mnemonic").agg(F.count("*").alias("n"), F.sum("site").alias("sites"), F.sum("writes_to").alias("targets"))


@_register(f"""WITH {_CELLS} SELECT dump_id, CAST(addr // 16 * 16 AS INT) AS addr, string_agg(printf('%02X', b), ' ' ORDER BY cells.addr) AS bytes FROM cells GROUP BY dump_id, addr // 16""")
def memory_dump(spark, d):
    """Sixteen bytes a line."""
    rows = decode.image_lines(_shifted_images(spark, d))
    return rows.select("dump_id", "addr", F.trim(F.regexp_extract(F.regexp_replace("line", r"^\S+\s+", ""), r"^((?:[0-9A-F]{2}(?: |$))+)", 1)).alias("bytes"))


@_register(f"""WITH {_CELLS}, names AS (SELECT DISTINCT dump_id FROM cells), pairs AS (SELECT doc_id AS pair_id, doc_id::VARCHAR || ':0' AS a, (doc_id + 1)::VARCHAR || ':0' AS b FROM documents),
x AS MATERIALIZED (SELECT pair_id, addr, cells.b FROM pairs JOIN cells ON dump_id = a), y AS MATERIALIZED (SELECT pair_id, addr, cells.b FROM pairs JOIN cells ON dump_id = pairs.b),
d AS (SELECT pair_id, addr FROM x JOIN y USING (pair_id, addr) WHERE x.b <> y.b AND NOT (addr BETWEEN 53248 AND 55295 OR addr BETWEEN 56320 AND 57343)),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY addr) AS k FROM d), s AS (SELECT pair_id, count(*) AS changed, max(addr) FILTER (k <= 256)::INT AS last_shown FROM n GROUP BY 1)
SELECT p.pair_id, CASE WHEN p.a NOT IN (FROM names) THEN 'no snapshot ' || p.a WHEN p.b NOT IN (FROM names) THEN 'no snapshot ' || p.b END AS problem, coalesce(changed, 0) AS changed, last_shown FROM pairs p LEFT JOIN s USING (pair_id)""")
def named_diffs(spark, d):
    """Each document's image against the next one's: all changes counted, the first 256 shown."""
    k = F.col("doc_id")
    pairs = _t(spark, d, "documents").select(k.alias("pair_id"), F.concat(k.cast("string"), F.lit(":0")).alias("a"), F.concat((k + 1).cast("string"), F.lit(":0")).alias("b"))
    found = memdiff.image_diffs(_shifted_images(spark, d), pairs)
    return found.select("pair_id", "problem", "changed", F.try_element_at("shown", F.lit(-1))["addr"].alias("last_shown"))

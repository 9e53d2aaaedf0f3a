"""Text, label and vector search, digests."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrel.functions import text as T


def clamp(n: int, cap: int) -> int:
    """T7."""
    return max(1, min(cap, n))


def search_text(docs: DataFrame, query: str, limit: int = 10, chars: int = 240, key: str = "path", content: str = "content") -> DataFrame:
    """``key, match_at, words, snippet``: documents with the phrase; if none has it, those with most of its words.

    Ties and the limit go by key, so the result is the same on any cluster.  Both phases are
    one scan: rows carry the phrase flag, and the word rows go if any phrase row exists.
    """
    phrase = query.lower()
    words = [w for w in re.split(r"\W+", phrase) if len(w) >= 3 and w not in T.STOP_WORDS]
    low = F.lower(content)
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    rows = docs.select(key, content, low.contains(phrase).alias("_p"), hits.alias("words")).where("_p or words > 0")
    exact = rows.where("_p").withColumn("_rank", F.lit(0))
    any_exact = exact.select("_p").limit(1)
    ranked = rows.where("not _p").join(F.broadcast(any_exact.select(F.lit(1).alias("_any"))), F.lit(True), "left_anti").withColumn("_rank", -F.col("words"))  # one row or none
    top = exact.unionByName(ranked).orderBy("_rank", key).limit(limit)
    anchor = F.when(F.col("_p"), F.lit(phrase)).otherwise(F.lit(words[0] if words else phrase))
    at = F.call_function("locate", anchor, F.lower(content)) - 1
    return top.select(key, at.alias("match_at"), "words", T.snippet(F.col(content), anchor, chars).alias("snippet"))


def term_hits(docs: DataFrame, terms: Sequence[str], most: int = 20, key: str = "path", content: str = "content") -> DataFrame:
    """``key, distinct_terms, occurrences, score`` of documents with any of the terms (G10): 100 per distinct term, and an occurrence each up to ``most``.

    Occurrences don't overlap; case doesn't matter; terms that are equal then count once.
    """
    wanted = F.array_distinct(F.array(*[F.lit(t.lower()) for t in terms if t]).cast("array<string>"))
    low = F.lower(F.coalesce(content, F.lit("")))
    count = lambda t: ((F.length("_low") - F.length(F.replace(F.col("_low"), t, F.lit("")))) / F.length(t)).cast("long")
    rows = docs.select(key, low.alias("_low")).withColumn("_n", F.transform(wanted, count))
    sums = F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n)
    rows = rows.select(key, F.size(F.filter("_n", lambda n: n > 0)).alias("distinct_terms"), sums.alias("occurrences")).where("distinct_terms > 0")
    return rows.withColumn("score", 100 * F.col("distinct_terms") + F.least(F.col("occurrences"), F.lit(most)))


def preview(rows: DataFrame, columns: Sequence[str], chars: int = 200, addresses: Sequence[str] = ()) -> DataFrame:
    """The columns asked for, texts cut to a preview, and ``<c>_hex`` beside each address, null where it is (F8)."""
    types = dict(rows.dtypes)
    shown = [F.substring(F.col(f"`{c}`"), 1, chars).alias(c) if types[c] == "string" else F.col(f"`{c}`") for c in columns]
    return rows.select(*shown, *[T.hex_label(F.col(f"`{c}`")).alias(f"{c}_hex") for c in addresses])


def search_notes(docs: DataFrame, terms: Sequence[str], limit: int = 10, key: str = "path", content: str = "content") -> DataFrame:
    """First hit of each term per document, each place once (R2)."""
    t = docs.select(key, content, F.explode(F.array(*[F.lit(x.lower()) for x in terms])).alias("term"))
    at = F.call_function("locate", F.col("term"), F.lower(content))
    hit = t.withColumn("offset", at - 1).where("offset >= 0")
    one = hit.groupBy(key, "offset").agg(F.min("term").alias("term"))
    return one.orderBy(key, "offset").limit(limit)


def relevant_labels(labels: DataFrame, question: str, limit: int = 40) -> DataFrame:
    """Labels at an address of the question first, then names with one of its terms; the surest 20 if none."""
    raw = re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", question)
    terms = list(dict.fromkeys(w.lower() for w in raw if w.lower() not in T.STOP_WORDS))[:8]
    addresses = list(dict.fromkeys(int(x, 16) for x in re.findall(r"(?:\$|0[xX])([0-9A-Fa-f]{2,4})(?![0-9A-Fa-f])", question)))[:16]
    at = F.col("addr").isin(*addresses) if addresses else F.lit(False)
    named = F.lit(False)
    for t in terms:
        named = named | F.lower("name").contains(t)
    rows = labels.select("addr", "name", "kind", "confidence", at.alias("_at"), (at | named).alias("_hit"))
    found = rows.where("_hit")
    rest = rows.join(F.broadcast(found.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), "left_anti")  # one row or none
    rest = rest.orderBy(F.desc("confidence"), "addr", "name").limit(limit if not terms and not addresses else min(limit, 20))
    top = found.orderBy((~F.col("_at")).cast("int"), F.desc("confidence"), "addr", "name").limit(limit)
    return top.unionByName(rest).drop("_at", "_hit")


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a guard for zero norms, in double precision."""
    q = np.asarray(query, np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    lit = F.array(*[F.lit(float(x)) for x in q])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, lit, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return dot / F.greatest(norm, F.lit(1e-12))


def vector_search(rows: DataFrame, query: Sequence[float], k: int = 10, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Top k by cosine, then key (R4, T3). Vectors of another size are an error, as in any comparison of them."""
    n = len(query)
    checked = F.when(F.size(vector) == n, F.col(vector)).otherwise(F.raise_error(F.lit(f"vector size differs from {n}")).cast("array<float>"))
    return rows.select(key, cosine(checked, query).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid_rerank(rows: DataFrame, query: Sequence[float], terms: Sequence[str], k: int = 8, threshold: float = 0.0, per_source: int = 2, key: str = "id", vector: str = "embedding", text: str = "text", source: str = "source") -> DataFrame:
    """Over-fetch by cosine, re-rank by 0.8 cosine + 0.2 lexical share, cap per source."""
    fetch = max(8 * k, k + 8)
    top = rows.select(key, source, text, cosine(F.col(vector), query).alias("cosine")).where(F.col("cosine") >= threshold).orderBy(F.desc("cosine"), key).limit(fetch)
    hits = sum((F.lower(text).contains(t.lower()).cast("int") for t in terms), F.lit(0))
    lexical = hits / max(1, len(terms))
    scored = top.withColumn("score", 0.8 * F.col("cosine") + 0.2 * lexical)
    w = Window.partitionBy(source).orderBy(F.desc("score"), key)  # rows of the over-fetch only
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source).orderBy(F.desc("score"), key).limit(k).select(key, source, "cosine", "score")


def collect_chunks(facets: dict[str, DataFrame]) -> DataFrame:
    """``chunk_id, facet, source, text`` of all facets; ids are 16 digits of a hash."""
    out = None
    for facet, df in sorted(facets.items()):
        part = df.select(F.substring(F.sha1(F.concat_ws("\u0001", F.lit(facet), "source", "text")), 1, 16).alias("chunk_id"), F.lit(facet).alias("facet"), "source", "text")
        out = part if out is None else out.unionByName(part)
    return out


def replace_vectors(existing: DataFrame, fresh: DataFrame, source: str = "source") -> DataFrame:
    """Vectors of re-ingested sources give way to the fresh ones."""
    return existing.join(fresh.select(source).distinct(), source, "left_anti").unionByName(fresh)


def embedding_misses(texts: DataFrame, cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """``cache_key, text``: distinct texts without a valid cached vector, in first-seen order.

    ``texts``: ``pos, text``; ``cache``: ``cache_key, vector``; a vector of another size is a miss.
    """
    key = F.sha2(F.concat_ws("\u0001", F.lit(model), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256)
    once = texts.withColumn("cache_key", key).groupBy("cache_key").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))
    return once.join(cache.where(F.size("vector") == dimensions).select("cache_key"), "cache_key", "left_anti").orderBy("pos").select("cache_key", "text")


def budgeted(rows: DataFrame, budget: int, order: Sequence[str], text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in order until the first that would exceed the budget of characters; none after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_sum")


def digest(sections: Sequence[tuple[str, DataFrame, int]], limit: int = 32_000) -> str:
    """Sections' lines under headings, each capped, redacted, the whole clipped.

    Each section is a limited query whose lines (column ``line``, in order of ``ord``) reach the
    driver; nothing larger than the caps does.
    """
    parts = []
    for title, df, cap in sections:
        lines = [r["line"] for r in df.orderBy("ord").limit(cap).select(T.redact(F.col("line")).alias("line")).collect()]
        if lines:
            parts.append(f"## {title}\n" + "\n".join(lines))
    text = "\n\n".join(parts)
    return text if len(text) <= limit else text[:limit] + "…[truncated]"


def dense_windows(docs: DataFrame, terms: Sequence[str], before: int = 500, after: int = 900, most: int = 6, small: int = 4_000, key: str = "path", content: str = "content") -> DataFrame:
    """``key, start, end, score``: windows around hits, best first, without overlap.

    A window scores 100 per distinct term and 1 per occurrence, 20 at most.  A small document
    without a hit stays whole with score 1.  A group is one document's hits.
    """
    low = [t.lower() for t in terms]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            text = (getattr(row, content) or "").lower()
            hits = sorted((m.start(), t) for t in low for m in re.finditer(re.escape(t), text))
            windows = []
            for at, _ in hits:
                a, b = max(0, at - before), min(len(text), at + after)
                inside = [t for p, t in hits if a <= p < b]
                windows.append((100 * len(set(inside)) + min(len(inside), 20), a, b))
            chosen: list[tuple[int, int, int]] = []
            for s, a, b in sorted(windows, key=lambda x: (-x[0], x[1])):
                if len(chosen) < most and all(b <= c or a >= d for _, c, d in chosen):
                    chosen.append((s, a, b))
            if not hits and text and len(text) <= small:
                chosen = [(1, 0, len(text))]
            out += [(getattr(row, key), a, b, s) for s, a, b in chosen]
        return pd.DataFrame(out, columns=[key, "start", "end", "score"])

    schema = docs.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("score")).schema

    def run(batches):
        for pdf in batches:
            yield pick(pdf)

    return docs.select(key, content).mapInPandas(run, schema)


def resolve_evidence(tokens: DataFrame, paths: DataFrame, labels: DataFrame, hypotheses: DataFrame, events: DataFrame) -> DataFrame:
    """``token, type, target``: a path, an address, a hypothesis or an event, the latter by unique prefix too."""
    t = tokens.select("token").distinct().withColumn("addr", T.parse_address(F.when(F.col("token").rlike(r"^(?:\$|0[xX])"), F.col("token"))))
    by_path = t.join(paths.select(F.col("path").alias("token")).distinct(), "token").select("token", F.lit("path").alias("type"), F.col("token").alias("target"))
    by_addr = t.where("addr is not null").join(labels.groupBy("addr").agg(F.max_by("name", "confidence").alias("name")), "addr", "left").select("token", F.lit("address").alias("type"), F.coalesce("name", T.hex_label(F.col("addr"))).alias("target"))

    lengths = [r[0] for r in tokens.where("length(token) >= 4").select(F.length("token")).distinct().collect()] or [4]  # lengths of tokens: a few numbers

    def by_id(rows: DataFrame, column: str, kind: str) -> DataFrame:
        ids = rows.select(F.col(column).alias("target")).distinct()
        heads = ids.select("target", F.explode(F.array_distinct(F.array(*[F.substring("target", 1, n) for n in lengths]))).alias("token"))
        hit = t.where("addr is null and length(token) >= 4").join(heads, "token")
        g = hit.groupBy("token").agg(F.count("*").alias("n"), F.max(F.when(F.col("target") == F.col("token"), F.col("target"))).alias("exact"), F.min("target").alias("only"))
        return g.where("exact is not null or n = 1").select("token", F.lit(kind).alias("type"), F.coalesce("exact", "only").alias("target"))

    rank = {"path": 0, "address": 1, "hypothesis": 2, "event": 3}
    every = by_path.unionByName(by_addr).unionByName(by_id(hypotheses, "hyp_id", "hypothesis")).unionByName(by_id(events, "id", "event"))
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    return every.groupBy("token").agg(F.min_by(F.struct("type", "target"), order).alias("x")).select("token", "x.*")


def prior_answers(turns: DataFrame, question: str, most: int = 6) -> DataFrame:
    """Latest accepted turns on other questions."""
    return turns.where((F.col("verdict") == "accept") & (F.lower(F.trim("question")) != question.strip().lower())).orderBy(F.desc("ts"), F.desc("run_id")).limit(most)


def recent_runs(runs: DataFrame, question: str, limit: int = 5) -> DataFrame:
    """Runs of the same question first, then newest."""
    same = F.when(F.col("question") == question, 0).otherwise(1)
    return runs.orderBy(same, F.desc("ts"), F.desc("run_id")).limit(clamp(limit, 100))


def recent_excerpts(results: DataFrame, covered: DataFrame | None = None, limit: int = 12, chars: int = 2000) -> DataFrame:
    """Newest results, compacted ones left out if given, clipped and redacted; ties by id."""
    rows = results.join(covered, "event_id", "left_anti") if covered is not None else results
    top = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
    return top.select("event_id", "ts", T.redact(T.clip(F.col("data"), chars)).alias("excerpt"))


def listing_head(texts: DataFrame, lines: int = 120) -> DataFrame:
    """First lines of the first ingested listing (Z16). ``path, content, log_pos``."""
    first = texts.orderBy("log_pos").limit(1)
    return first.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where(F.col("line_no") < lines)


def consolidated_summaries(events: DataFrame, most: int = 3) -> DataFrame:
    """Latest compaction summaries with their fields."""
    p = F.from_json("payload", "summary string, events_compacted array<string>")
    return events.where(F.col("kind") == "compaction").orderBy(F.desc("ts"), F.desc("id")).limit(most).select("id", "ts", p.alias("p")).select("id", "ts", "p.*")


def address_parity(responses: DataFrame) -> DataFrame:
    """Warning where the first address of a response lies over 32 before or 256 after the request."""
    first = T.parse_address(F.regexp_extract("response", r"\$([0-9A-Fa-f]{4})", 1))
    off = first - F.col("requested")
    return responses.withColumns({"first": first, "warning": F.when((off < -32) | (off > 256), F.concat(F.lit("response starts at "), T.hex_label(first)))})


def direct_writes(lines: DataFrame, addr: int) -> DataFrame:
    """Listing lines with a literal write to an address."""
    digits = F.regexp_extract("line", r"(?i)\b(?:ST[AXYZ]|INC|DEC|ASL|LSR|ROL|ROR)\s+\$([0-9A-F]{1,4})(?![0-9A-F])", 1)
    return lines.where(F.conv(digits, 16, 10).cast("int") == addr)


def catalog_page(catalog: DataFrame, text: str = "", status: str | None = None, page: int = 1, size: int = 25) -> DataFrame:
    """Rows that contain the text and have the status, one page of them by name."""
    hit = catalog.where(F.lower(F.concat_ws(" ", "name", F.coalesce("notes", F.lit("")))).contains(text.lower())) if text else catalog
    hit = hit.where(F.col("status") == status) if status else hit
    return hit.orderBy("name").offset((max(1, page) - 1) * size).limit(size)


def question_relevance(question: str, text: Column) -> Column:
    """Share of the question's words of three characters or more that the text has."""
    words = sorted(set(re.findall(r"[a-z0-9]{3,}", question.lower())))
    if not words:
        return F.lit(0.0)
    have = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]{3,})"), 1)
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), have)) / len(words)


def best_candidates(candidates: DataFrame, question: str, text: str, keys: list[str], order: str, most: int = 2) -> DataFrame:
    """The ``most`` candidates per key by confidence x (1 + relevance to the question), ties by ``order`` (T5)."""
    rated = candidates.withColumn("priority", F.col("confidence") * (1 + question_relevance(question, F.col(text))))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"), order))
    return rated.withColumn("place", place).where(F.col("place") <= most)

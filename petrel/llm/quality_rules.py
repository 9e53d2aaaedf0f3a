"""Quality rules whose cutoffs follow the corpus, in DataFrame operations only.

Per document a few integer measures are taken.  Per language and source each measure is
summarised by a mergeable quantile sketch: counts in buckets that grow with the value (32
per octave, so a quantile is off by 1/32 at most; small values are exact).  Sketches merge
by adding counts, in any order and with the same result, so groups merge into languages
and those into the whole corpus.  A group's sketch is shrunk to its language's as if it held
``PRIOR`` more documents of that, and the language's to the corpus's, so small groups take
over their parent's cutoffs by degrees, without a switch.

A measure's upper fence is its tail quantile moved outward by a multiple of its distance from
the median, the lower one likewise.  There are no fixed cutoffs: where a tail is tied with the
median the fence is that value.  A document is outside only if it would be with one symbol,
line or word fewer, as its own size allows no finer statement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .skew import join_keyed

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
#: Fixed base rules: fewer words, or a larger percentage of words in repeated windows, fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Documents of the parent's kind that a group's sketch counts besides its own.
PRIOR = 50
#: measure: (tail quantile per 1000, multiple of its distance from the median, has a lower fence).
#: Shares are per 1000, word length per 100.  Up to a tenth of a group may be junk of symbols and
#: glued words; repeated lines and words are common enough in good texts that only the far tail counts.
MEASURES = {"m_symbols": (900, 3, False), "m_word_length": (900, 3, True), "m_dup_lines": (980, 1, False), "m_repeat": (980, 1, False)}
#: Buckets per octave is 2 to this power.
BITS = 5


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of 8 that occur twice or more, from the windows' hashes."""
    n = F.size(words)

    def doubled(hs: Column, span: int) -> Column:
        """Hashes of 2 x span words from those of span words."""
        if span == WINDOW_WORDS:
            return hs
        m = n - 2 * span + 1
        wider = _bind(hs, lambda x: F.zip_with(F.slice(x, 1, m), F.slice(x, span + 1, m), lambda a, b: F.xxhash64(a, b)))
        return doubled(wider, 2 * span)

    hashes = doubled(F.transform(words, lambda w: F.xxhash64(w)), 1)

    def covered(hs: Column) -> Column:
        keyed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            m = F.size(s)
            same = lambda j, k: s[j]["h"] == s[k]["h"]
            twice = F.filter(s, lambda x, j: ((j > 0) & same(F.greatest(j - 1, F.lit(0)), j)) | ((j < m - 1) & same(F.least(j + 1, m - 1), j)))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return _bind(starts, lambda p: F.aggregate(p, F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(WINDOW_WORDS), i - a["last"])).alias("n")), lambda a: a["n"]))

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(_bind(keyed, repeated))

    return F.when(n <= WINDOW_WORDS, 0).otherwise(_bind(hashes, covered)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document (null text: no word)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("_t", GAP), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    # both arrays are bound, or the optimiser would split the text anew for each window of it
    of_words = _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select("doc_id", "lang", "source", t.alias("_t"))
    return rows.select(
        "doc_id", "lang", "source", F.length(F.regexp_replace("_t", GAP, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.explode(F.array(F.struct(of_words.alias("w"), of_lines.alias("l")))).alias("x"),
    ).select("doc_id", "lang", "source", "word_chars", "n_symbols", "x.w.*", "x.l.*")


def _name(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def measures(rows: DataFrame) -> DataFrame:
    """The measures, ``t_`` of each with one unit fewer, names of language and source, and the base rules."""
    per = lambda a, b, scale: F.when(F.col(b) > 0, F.floor(a * scale / F.col(b))).otherwise(0).cast("long")
    less = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    shares = {"m_symbols": ("n_symbols", "n_words"), "m_dup_lines": ("n_dup_lines", "n_lines"), "m_repeat": ("n_repeat_words", "n_words")}
    rows = rows.withColumns({m: per(F.col(a), b, 1000) for m, (a, b) in shares.items()} | {f"t_{m}": per(less(a), b, 1000) for m, (a, b) in shares.items()})
    return rows.withColumns({
        "m_word_length": per(F.col("word_chars"), "n_words", 100), "t_m_word_length": per(F.col("word_chars"), "n_words", 100),
        "ln": _name(F.col("lang")), "sn": _name(F.col("source")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def bucket(x: Column) -> Column:
    """A non-negative integer's bucket: exact below 64, then 32 per octave; ``bucket_value`` is its lower end."""
    octave = F.length(F.bin(x)) - 1 - BITS
    return F.when(x < 2 ** (BITS + 1), x).otherwise(octave * 2**BITS + F.floor(x / F.pow(F.lit(2.0), octave))).cast("long")


def bucket_value(b: Column) -> Column:
    octave = F.floor(b / 2**BITS) - 1
    return F.when(b < 2 ** (BITS + 1), b).otherwise((b - octave * 2**BITS) * F.pow(F.lit(2.0), octave)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """ln, sn, measure, bucket, n over the documents that pass the base rules."""
    named = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    return rows.where("not base_failed").select("ln", "sn", F.inline(named)).groupBy("ln", "sn", "measure", "bucket").agg(F.count("*").alias("n"))


def _shrunk(own: DataFrame, parent: DataFrame, keys: list[str], shared: list[str], prior: int) -> DataFrame:
    """Sketch of groups (``keys, measure, bucket, n``), shrunk to their parent's: n becomes a weight, ``total`` the sum of weights, ``docs`` the group's documents.

    With parent weights P of sum T, a bucket of n documents weighs n T + prior P: whole numbers, so nothing depends on the order of adding.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    groups = own.groupBy(*keys, "measure").agg(F.sum("n").alias("docs"))
    grid = groups.join(parent.select(*shared, "measure", "bucket", F.col("n").alias("p"), F.col("total").alias("t")), [*shared, "measure"])
    grid = grid.join(own, [*keys, "measure", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weight = big("n") * F.col("t") + F.lit(prior) * F.col("p")
    total = (F.col("docs") + prior).cast("decimal(20,0)") * F.col("t")
    return grid.select(*keys, "measure", "bucket", "docs", weight.cast("decimal(38,0)").alias("n"), total.cast("decimal(38,0)").alias("total"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``ln, sn, docs`` and per measure a struct ``f_`` of ``lo, hi``: a row per group; ``sketch`` is a saved table of ``sketches``."""
    corpus = sketch.groupBy("measure", "bucket").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    corpus = corpus.withColumn("total", F.sum("n").over(Window.partitionBy("measure")))
    by_lang = _shrunk(sketch.groupBy("ln", "measure", "bucket").agg(F.sum("n").alias("n")), corpus, ["ln"], [], prior)
    s = _shrunk(sketch, by_lang, ["ln", "sn"], ["ln"], prior)
    s = s.withColumn("upto", F.sum("n").over(Window.partitionBy("ln", "sn", "measure").orderBy("bucket")))
    of = lambda i: F.create_map(*[x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[i]))])[F.col("measure")]
    at = lambda k: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * k, bucket_value(F.col("bucket"))))
    q = s.groupBy("ln", "sn", "measure").agg(at(1000 - of(0)).alias("low"), at(F.lit(500)).alias("mid"), at(of(0)).alias("high"), F.max("docs").alias("docs"))
    q = q.withColumns({"lo": F.col("low") - of(1) * (F.col("mid") - F.col("low")), "hi": F.col("high") + of(1) * (F.col("high") - F.col("mid"))})
    one = [F.max(F.when(F.col("measure") == m, F.struct("lo", "hi"))).alias(f"f_{m}") for m in MEASURES]
    return q.groupBy("ln", "sn").agg(F.max("docs").alias("docs"), *one)


def quality_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Base counts, measures, ``base_failed`` and ``kept`` of every document.

    Null and empty texts have no words and fail the base rule.  Long texts are measured whole.
    Null languages and sources are groups of their own.  Rows that repeat a doc_id are judged
    each by its own text.  Values tied with a fence are inside.  Other columns are ignored.
    Empty table: no rows.
    """
    rows, _ = scratch.save(measures(features(docs)), "measures")  # a few numbers per document; texts are read once
    sketch, path = scratch.save(sketches(rows), "sketch")
    limits, _ = scratch.save(fences(sketch, prior), "fences")
    scratch.drop(docs.sparkSession, path)
    out = join_keyed(rows, limits, ["ln", "sn"], "docs", "left")  # groups none of which passes the base rules have no fences
    outside = F.lit(False)
    for m, (_, _, low) in MEASURES.items():
        fence = F.col(f"f_{m}")
        outside = outside | (F.col(f"t_{m}") > fence["hi"])
        if low:
            outside = outside | (F.col(f"t_{m}") < fence["lo"])
    kept = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES, "base_failed", kept.alias("kept"))

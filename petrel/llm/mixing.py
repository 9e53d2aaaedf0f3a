"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations.

A document's inclusion is c = min(2, level * weight) copies, where the weight is the square root
of its words unless a column is given, and the level is its source's own, so that the expected
words are the source's target.  floor(c) copies are certain.  The rest, p = c - floor(c), is a
fixed-size sample of unequal probabilities: every document draws u in (0, 1) from a hash of its
id, and the smallest ranks ``(u / (1 - u)) / (p / (1 - p))`` are taken until the words come
nearest to what the certain copies leave of the target.  Only whole documents are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .skew import join_keyed

#: Mixing weights, dealt to the sources in code-point order, again and again.
WEIGHTS = (5, 2, 1)
#: The mix's words as a percentage of all words, and the most copies of a document.
TOTAL_PERCENT, MAX_COPIES = 150, 2
#: Cells per refinement of the search for a source's cut; two refinements precede the exact one.
CELLS = 4096
#: Expected copies this near to a whole number are that number.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_copies: int = MAX_COPIES
) -> DataFrame:
    """``sizes`` (``source, source_size`` and any more) with ``target``, one row per source.

    Targets share ``total_percent`` of all words by weight; none goes above ``max_copies``
    times its source, and the excess is reshared by weight among the others.  The level at
    which resharing ends is found in closed form: sort the sources by cap / weight, and the
    capped ones are a prefix.  These are the only global orders: three windows over a row per
    source in one task, good for some millions of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = sizes.withColumn("w", w.cast("long")).withColumns({
        "total": F.sum("source_size").over(everything),
        "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_copies,
        "left_w": F.sum("w").over(from_here),
    })
    # at a source's turn: what is left for it and all later ones, times 100
    s = s.withColumn("rest", F.col("total") * total_percent - F.col("capped") * 100)
    fits = F.col("rest") * F.col("w") <= F.col("source_size") * max_copies * 100 * F.col("left_w")
    place = F.struct((F.col("source_size") / F.col("w")).alias("ratio"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    s = s.withColumn("place", place)
    s = s.withColumn("level", F.min(F.when(fits, F.struct("place", "rest", "left_w"))).over(everything))
    shared = (F.col("level.rest") * F.col("w")).cast("double") / (F.col("level.left_w") * 100).cast("double")
    cap = (F.col("source_size") * max_copies).cast("double")
    return s.select(*sizes.columns, F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), cap).otherwise(shared).alias("target"))


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """52 bits of a digest as a number strictly between 0 and 1; a row without an id draws by its text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def _drawn(docs: DataFrame, seed: int, weight_col: str | None) -> list[Column]:
    """doc_id, source and what decides on a document: name of its source, size, random number, weight."""
    size = word_count(F.col("text"))
    weight = F.floor(F.col(weight_col).cast("double") * 1000) if weight_col else F.floor(F.sqrt(size.cast("double")))
    return [
        F.col("doc_id"), F.col("source"), F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("n")).alias("name"), size.alias("size"),
        _uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), F.greatest(F.lit(0), F.coalesce(weight, F.lit(0))).cast("long").alias("w"),
    ]


def _ranked(rows: DataFrame, max_copies: int) -> DataFrame:
    """Rows of documents with their source's ``level``: certain copies, odds of one more, rank and its cell."""
    c = F.least(F.lit(float(max_copies)), F.coalesce(F.col("level") * F.col("w"), F.lit(float(max_copies))))
    whole = F.floor(c + NEAR)
    rows = rows.withColumn("c", c).withColumns({"whole": whole, "p": F.greatest(F.lit(0.0), F.col("c") - whole)})
    rank = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.withColumn("rank", rank)
    cell = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * (CELLS * CELLS)), F.lit(CELLS * CELLS - 1))
    return rows.withColumns({"c1": F.floor(cell / CELLS), "c2": F.pmod(cell, F.lit(CELLS))})


def _copies(rows: DataFrame) -> Column:
    """Copies of ranked rows that have their source's cut."""
    here = F.struct("c1", "c2")
    inside = (F.col("c1") == F.col("cut1")) & (F.col("c2") == F.col("cut2")) & (F.struct("rank", "doc_id", "size") <= F.col("cut"))
    taken = F.coalesce(here < F.struct(F.col("cut1").alias("c1"), F.col("cut2").alias("c2")), F.lit(False)) | F.coalesce(inside, F.lit(False))
    return (F.col("whole") + F.when((F.col("p") > 0) & (F.col("size") > 0) & taken, 1).otherwise(0)).cast("long")


def source_cuts(base: DataFrame, weights: Sequence[int], total_percent: int, max_copies: int) -> DataFrame:
    """One saved row per source: ``name, n, source_size, target, level, cut1, cut2, cut``; ``base`` is a saved table of ``_drawn`` columns.

    The cut of a source is found without sorting the source anywhere: its ranks lie on a scale
    of 4096 x 4096 cells, words are summed by cell (pre-aggregated), and only the documents of
    the one cell that holds the cut are ordered.
    """
    spark, made = base.sparkSession, []

    def saved(df: DataFrame, name: str) -> DataFrame:
        df, path = scratch.save(df, name)
        made.append(path)
        return df

    per = saved(base.groupBy("name", "source", "w").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "weights")
    targets = source_targets(per.groupBy("name", "source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), weights, total_percent, max_copies)
    targets = saved(targets, "targets")
    # the level: heavy documents stop at max_copies, the others share what is left by weight
    live = per.where("words > 0 and w > 0").select("name", "w", "words").join(targets.select("name", "target"), "name")
    heavier = Window.partitionBy("name").orderBy(F.desc("w"))
    capped = F.coalesce(F.sum("words").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum(F.col("words").cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)")).over(heavier.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    live = live.withColumn("level", (F.col("target") - capped * float(max_copies)) / rest)
    level = live.where(F.col("level") * F.col("w") <= max_copies).groupBy("name").agg(F.max_by("level", "w").alias("level"))
    at = _ranked(per.join(level, "name", "left").withColumn("u", F.lit(0.5)), max_copies)
    certain = at.groupBy("name").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    cuts = targets.join(level, "name", "left").join(certain, "name").withColumn("budget", F.col("target") - F.col("certain"))
    cuts = saved(cuts.drop("certain"), "levels")

    def open_rows(*cell: str) -> DataFrame:
        rows = _ranked(join_keyed(base.where("size > 0").drop("source"), cuts, ["name"], "n"), max_copies).where("p > 0 and budget > 0")
        for c, cut in zip(("c1", "c2"), cell, strict=False):
            rows = rows.where(F.col(c) == F.col(cut))
        return rows

    before = "cast(0 as long)"
    for c, cut, cell in (("c1", "cut1", ()), ("c2", "cut2", ("cut1",))):
        sums = open_rows(*cell).groupBy("name", c).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first(F.expr(before)).alias("start"))
        run = Window.partitionBy("name").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
        sums = sums.withColumn("from", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        found = sums.where("`from` < budget and `from` + words >= budget").select("name", F.col(c).alias(cut), F.col("from").alias(f"before_{cut}"))
        cuts = saved(cuts.join(found, "name", "left"), cut)
        before = f"before_{cut}"
    run = Window.partitionBy("name").orderBy("rank", "doc_id", "size")
    last = open_rows("cut1", "cut2").withColumn("upto", F.col("before_cut2") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    # the prefix that comes nearest to the budget: all that fit, and the next if it lands nearer
    near = last.where(F.col("upto") - F.col("budget") <= F.col("budget") - (F.col("upto") - F.col("size")))
    cut = near.groupBy("name").agg(F.max(F.struct("rank", "doc_id", "size")).alias("cut"))
    out, _ = scratch.save(cuts.join(cut, "name", "left").select("name", "n", "source_size", "target", "level", "cut1", "cut2", "cut"), "cuts")
    scratch.drop(spark, *made)
    return out


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_copies: int = MAX_COPIES,
    seed: int = 0, weight_col: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per document.

    ``taken`` is copies times size.  A run with the same seed decides alike on any cluster,
    since the random number is a digest of the id.  ``weight_col`` replaces the square root of
    the size as the weight of a document (to three decimals; null and negative count as 0).

    Texts, long ones too, are read once.  Null texts have size 0 and are taken 0 words.  A null
    source is a source of its own, last in order.  Documents of weight 0 are never taken.  Rows
    that repeat a doc_id share their random number; rows without a doc_id draw by their texts.
    Ties at a source's cut go by doc_id, then size, and rows equal in all are taken together.
    Other columns are ignored.  Empty table: no rows.
    """
    base, _ = scratch.save(docs.select(*_drawn(docs, seed, weight_col)), "sizes")
    cuts = source_cuts(base, weights, total_percent, max_copies)
    out = _ranked(join_keyed(base, cuts, ["name"], "n"), max_copies)
    return out.select("doc_id", "source", "size", "source_size", "target", _copies(out).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_copies: int = MAX_COPIES,
    seed: int = 0, weight_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with its columns, whatever their names.

    Texts of sources with more than a thousandth of all rows are not shuffled.
    """
    base, path = scratch.save(docs.select(*_drawn(docs, seed, weight_col)), "sizes")
    cuts = source_cuts(base, weights, total_percent, max_copies)
    scratch.drop(docs.sparkSession, path)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _ranked(join_keyed(docs.select(row, *_drawn(docs, seed, weight_col)).drop("source"), cuts, ["name"], "n"), max_copies)
    rows = rows.withColumn("copies", _copies(rows)).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

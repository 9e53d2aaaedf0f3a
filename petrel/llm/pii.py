"""Personal data by weak supervision, in DataFrame operations only.

Fixed patterns find emails, addresses, cards and phones; wider ones find candidates of the
same matter in other dress (``mail``: an address spelt out, ``number``: digits grouped like a
phone's, ``name``: after a form of address).  Five labelers vote on every span for (1),
against (-1) or not at all (0): its pattern, a check of its value, a gazetteer, the words before
it and the characters around it.

Votes are counted by pattern (kind and votes: 1701 at most).  Expectation-maximisation over these
counts estimates how often each labeler votes how on real and on false spans, and how often
each kind is real; no span has a label.  The resulting odds of all spans train the final span
classifier, naive Bayes over hashed features of the span and its surroundings, with whole-number
sums, so reruns agree.  Spans of the fixed patterns always stay; of the others those remain that
the classifier takes for real.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

KINDS = ("email", "ip", "card", "phone", "mail", "number", "name")
BASE = 4
#: Fixed patterns, with possessive parts and anchors that change no match: a run of characters is tried once, not from each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z]{2,24}+",
    "number": r"(?<![0-9A-Za-z+.@])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,5}[\x20./-][0-9]{2,6}(?:[\x20./-][0-9]{2,6})?+(?![0-9A-Za-z@])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra)\.?\x20\p{Lu}\p{Ll}{1,24}+(?:\x20\p{Lu}\p{Ll}{1,24}+)?+",
}
#: What a text must have for a kind to occur in it: cheaper to see than the pattern is to search.
SCREENS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]{2}|[0-9][\\x20-][0-9]", "phone": "+", "mail": "dot", "number": "[0-9]{2}[).\\x20/-]", "name": r"(?:Mr|Ms|Dr|Prof|Herr|Frau|Monsieur|M[a-z]*me|Señor|Sra)\b"}
#: Gazetteers: endings of hosts, calling codes, given names.
HOSTS = "com org net edu gov info io co uk de fr es it nl ch at be eu us ca au in br mx"
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 64 65 81 82 86 90 91 351 353 358 420"
GIVEN = "Anna Maria Peter Paul John James Mary Robert Michael Linda David Jean Marie Pierre Sophie Hans Karl Petra Juan Jose Carmen Luis Ana"
#: Words before a span that speak for or against personal data, in the four languages of the corpus.
CUES = r"(?i)(?:phone|tel|call|mobile|fax|cell|mail|contact|write|card|visa|address|host|name|telefon|handy|anruf|kontakt|karte|adresse|appel|carte|contacter|llam|tarjeta|correo|contacto|direcci)[^\n]{0,16}$"
AGAINST = r"(?i)(?:isbn|issn|version|order|invoice|page|pages|chapter|fig|table|no\.|nr\.|seite|rechnung|facture|pagina|section|§|\$|€|£)[^\n]{0,6}$"
#: Code points of the text before a span that are looked at.
BEFORE = 32
ROUNDS, BUCKETS, LEAST_ODDS = 15, 1024, 9.0
LABELERS = 5
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_SPAN = "array<struct<start:int,kind:int,end:int,votes:array<int>,features:array<int>>>"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running folds of an integer array, the item included; in blocks, as each append copies what it appends to."""
    folds = lambda ys, at: F.slice(F.aggregate(ys, F.array(at), lambda a, y: F.concat(a, F.array(step(F.element_at(a, -1), y)))), 2, F.greatest(F.size(ys), F.lit(1)))
    lowest = F.lit(0)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, lowest, step))
        return _bind(folds(totals, lowest), lambda upto: F.flatten(F.transform(blocks, lambda b, i: folds(b, F.when(i == 0, lowest).otherwise(upto[F.greatest(i - 1, F.lit(0))])))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, block))
    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(_bind(cut, joined))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, m, before, after) of all matches: texts between them give the places."""

    def placed(x: Column) -> Column:
        between, found = x["between"], x["found"]
        lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.length(b) + F.length(m))
        return _bind(running(lengths, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, i: F.struct(
            (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("m"), F.right(between[i], F.lit(BEFORE)).alias("before"), F.left(between[i + 1], F.lit(1)).alias("after"))))

    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _bind(both, placed)


def _valid(kind: str, m: Column) -> Column:
    """The fixed tests of a match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "number":
        return F.length(digits).between(7, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.when(no, -1).otherwise(0) if no is not None else F.lit(0)
    return F.when(yes, 1).otherwise(against)


def votes(kind: str, x: Column) -> Column:
    """What the labelers say of a span: pattern, value, gazetteer, context, surroundings."""
    m, before, after = x["m"], x["before"], x["after"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    ending = F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1))
    listed = lambda words, value: F.array_contains(F.array(*[F.lit(w) for w in words.split()]), value)
    yes, none = F.lit(1), F.lit(0)
    pattern = {"number": _vote(m.rlike(r"^\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}$"), m.rlike(r"^[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}$")), "name": none}.get(kind, yes)
    value = {
        "email": _vote(F.length(ending).between(2, 24), F.length(ending) < 2), "mail": _vote(F.length(ending) <= 6), "ip": _vote(~m.rlike(r"^0|\.0{2,}"), m.rlike(r"^0")), "card": yes,
        "phone": _vote(F.length(digits).between(10, 13)), "number": _vote(F.length(digits).between(9, 12), F.length(digits) < 8), "name": _vote(m.rlike(r"\p{Ll}{2}$")),
    }[kind]
    gazetteer = {
        "email": _vote(listed(HOSTS, ending)), "mail": _vote(listed(HOSTS, ending), ~listed(HOSTS, ending)), "ip": _vote(~m.rlike(r"^(?:0|10|127|192\.168|2[2-5][0-9])\."), m.rlike(r"^0\.")), "card": _vote(m.rlike("^[3-6]")),
        "phone": _vote(F.exists(F.array(*[F.lit(c) for c in CODES.split()]), lambda c: F.startswith(digits, c))), "number": none, "name": _vote(m.rlike(rf"\b(?:{'|'.join(GIVEN.split())})\b")),
    }[kind]
    context = _vote(before.rlike(CUES), before.rlike(AGAINST))
    glued = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
    return F.array(*[v.cast("int") for v in (pattern, value, gazetteer, context, _vote(~glued, glued))])


def features(kind: str, x: Column) -> Column:
    """Buckets of the span's features, of which each kind has its own: length, shape, last word before, characters around."""
    shape = F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(x["m"], r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "0"), F.lit(9))
    near = lambda c: F.when(c == "", "none").when(c.rlike(r"^\p{L}"), "letter").when(c.rlike(r"^\p{N}"), "digit").otherwise(c)
    said = [F.concat(F.lit("n"), F.length(x["m"]).cast("string")), F.concat(F.lit("s"), shape), F.concat(F.lit("w"), F.lower(F.regexp_extract(x["before"], r"(\p{L}+)\P{L}*$", 1)))]
    said += [F.concat(F.lit("b"), near(F.right(x["before"], F.lit(1)))), F.concat(F.lit("a"), near(x["after"]))]
    return F.array(*[(F.pmod(F.xxhash64(s), F.lit(BUCKETS)) + KINDS.index(kind) * BUCKETS).cast("int") for s in said])


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind with votes and features."""
    screen = text.rlike(SCREENS[kind]) if any(c in SCREENS[kind] for c in "[(") else text.contains(SCREENS[kind])
    of = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), votes(kind, x).alias("votes"), features(kind, x).alias("features"))
    return F.when(screen, F.transform(F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"])), of).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, wide`` of every row: spans with votes and features, by start; wide ones that meet a fixed one are left out."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", _spans(F.col("_t"), kind))
    parts = [F.col(f"_{k}") for k in KINDS]
    rows = rows.select("doc_id", F.explode(F.array(F.struct(F.array_sort(F.concat(*parts[:BASE])).alias("base"), F.array_sort(F.concat(*parts[BASE:])).alias("wide")))).alias("x"))

    def apart(x: Column) -> Column:
        """Wide spans that meet none of base: behind all that begin before their end."""
        fixed = F.transform(x["base"], lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("order"), b["end"].alias("end"), F.lit(-1).alias("i")))
        begins = F.transform(x["wide"], lambda b, i: F.struct((b["end"] - 1).alias("at"), F.lit(1).alias("order"), b["start"].alias("end"), i.alias("i")))

        def kept(line: Column) -> Column:
            reach = running(F.transform(line, lambda y: F.when(y["order"] == 0, y["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
            return _bind(reach, lambda r: F.transform(F.filter(F.transform(line, lambda y, j: F.struct(y["i"].alias("i"), ((y["order"] == 1) & (r[j] <= y["end"])).alias("free"))), lambda y: y["free"]), lambda y: y["i"]))

        places = F.array_sort(_bind(F.array_sort(F.concat(fixed, begins)), kept))
        return _bind(places, lambda p: F.transform(p, lambda i: x["wide"][i]))

    wide = F.when(F.size("x.wide") == 0, F.array().cast(_SPAN)).otherwise(apart(F.col("x")))
    return rows.select("doc_id", F.col("x.base").alias("base"), wide.alias("wide"))


def posterior(kind: Column, said: Column, law: Column) -> Column:
    """The chance that a span with these votes is real, under a law of ``prior, yes, no``."""
    p = law["prior"][kind]
    odds = F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.log(p / (1 - p)), lambda a, j: a + F.log(law["yes"][j * 3 + said[j] + 1] / law["no"][j * 3 + said[j] + 1]))
    return 1 / (1 + F.exp(-odds))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row ``law``: expectation-maximisation over ``kind, votes, n``, a row per pattern of votes (a bounded number).

    It starts from labelers that are right more often than not.  Counts get one smoothing
    span per outcome, so no reliability is 0 or 1 and an empty table gives a law too.
    """
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    many = lambda xs, n: F.array(*[F.lit(float(x)) for x in xs * n])
    start = F.struct(many([0.5], len(KINDS)).alias("prior"), many([0.1, 0.2, 0.7], LABELERS).alias("yes"), many([0.4, 0.4, 0.2], LABELERS).alias("no"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def step(law: Column) -> Column:
        weighed = F.transform("rows", lambda x: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * posterior(x["kind"], x["votes"], law)).alias("y")))

        def fitted(ws: Column) -> Column:
            prior = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: (1 + total(ws, lambda w: F.when(w["kind"] == k, w["y"]).otherwise(0.0))) / (2 + total(ws, lambda w: F.when(w["kind"] == k, w["n"]).otherwise(0.0))))
            cells = F.sequence(F.lit(0), F.lit(3 * LABELERS - 1))
            hit = lambda w, t: w["votes"][F.floor(t / 3).cast("int")] + 1 == t % 3
            of = lambda part: F.transform(cells, lambda t: (1 + total(ws, lambda w: F.when(hit(w, t), part(w)).otherwise(0.0))) / (3 + total(ws, part)))
            return F.struct(prior.alias("prior"), of(lambda w: w["y"]).alias("yes"), of(lambda w: w["n"] - w["y"]).alias("no"))

        return _bind(weighed, fitted)

    return rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda law, _: step(law)).alias("law"))


def span_classifier(spans: DataFrame, law: DataFrame) -> DataFrame:
    """One row ``prior, weights``: naive Bayes per kind over feature buckets (``BUCKETS`` of a kind at most), trained on the law's odds in millionths."""
    known = spans.join(F.broadcast(law), F.lit(True))
    known = known.select("kind", "features", F.round(posterior(F.col("kind"), F.col("votes"), F.col("law")) * 1_000_000).cast("long").alias("y"))
    add = lambda a, b: [F.sum("y").alias(a), F.sum(1_000_000 - F.col("y")).alias(b)]
    share = lambda part, whole: (F.col(part) + 1e6) / (F.col(whole) + 2e6)
    kinds = known.groupBy("kind").agg(*add("all_yes", "all_no"))  # a row per kind
    cells = known.select("kind", F.explode(F.array_distinct("features")).alias("f"), "y").groupBy("kind", "f").agg(*add("yes", "no"))
    cells = cells.join(F.broadcast(kinds), "kind").select("f", F.log(share("yes", "all_yes") / share("no", "all_no")).alias("w"))
    prior = kinds.select("kind", F.log((F.col("all_yes") + 1e6) / (F.col("all_no") + 1e6)).alias("w"))
    row = lambda df, k, name: df.agg(F.map_from_entries(F.collect_list(F.struct(k, "w"))).alias(name))
    return row(cells, "f", "weights").join(F.broadcast(row(prior, "kind", "prior")), F.lit(True))


def find_pii(docs: DataFrame, least_odds: float = LEAST_ODDS) -> DataFrame:
    """``doc_id, spans`` of every row: an array of (kind, start, end) in code points, by kind as in ``KINDS``, then start.

    Spans of the first four kinds are the fixed patterns' and always stay; of the others those whose
    odds by the final classifier are ``least_odds`` or more.  Null and empty texts have no
    spans.  Long texts are scanned whole, in time linear in their length.  Spans of one kind
    don't overlap, the leftmost wins; fixed ones of several kinds may.  Repeated rows are
    scanned each and count each as evidence.  Values tied with the odds are found.  Other columns are ignored.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    found, _ = scratch.save(candidates(docs), "spans")  # a few numbers per span: texts are read once
    spans = found.select(F.inline(F.concat("base", "wide")))
    law, at = scratch.save(reliabilities(spans.groupBy("kind", "votes").agg(F.count("*").alias("n"))), "law")
    model, model_at = scratch.save(span_classifier(spans, law), "model")
    out = found.join(F.broadcast(model), F.lit(True), "left")  # one row of BUCKETS weights a kind
    score = lambda x: F.aggregate(F.array_distinct(x["features"]), F.element_at("prior", x["kind"]), lambda a, f: a + F.coalesce(F.element_at("weights", f), F.lit(0.0)))
    real = F.filter("wide", lambda x: score(x) >= F.log(F.lit(float(least_odds))))
    shown = F.array_sort(F.transform(F.concat("base", real), lambda x: F.struct(x["kind"].alias("k"), x["start"].alias("start"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return out.select("doc_id", F.transform(shown, lambda x: F.struct(names[x["k"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))

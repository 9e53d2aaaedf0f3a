import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from petrel.llm import exact_dedup, line_dedup, mixing, quality_classifier, quality_rules, secrets, simhash, suffix_dedup, url_filters
from petrel.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, extra=False):
    ids = ids if ids is not None else range(len(texts))
    df = spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("h", "fp", "_key", "size", "kept", "bucket", "_t", "hash", "copies", "w", "runs", "_id", "_marks", "_stay", "_source", "col", "row", "o", "marks")}) if extra else df


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, ties, repeats, one long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "\n".join(para(12) for _ in range(9))
    texts = [None, "", " \n\t ", "one", "two words", para(60), shared, "intro line\n" + shared, shared + "\nouttro", para(30) + "\n" + para(30)]
    texts += [texts[5], texts[5].replace(" ", "  "), texts[5][:-3] + "xyz", "a" * 300, "a" * 300, "ab " * 200, para(9000), "ünïcödé " + para(20)]
    return texts + [para(25) for _ in range(12)]


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[root(a)] = root(b)
    assert set(got) == set(parent)
    names = {}
    for n in parent:
        assert names.setdefault(root(n), got[n]) == got[n]
    assert len(set(names.values())) == len(names)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_url_rules_and_aliases(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head></html>'
    rows = [
        (1, "http://a.example.org/es/x", ""), (2, "https://plain.net/p?x=1#top", link.format("http://a.example.org/es/x")), (3, "http://other.net/q", link.format("//plain.net/p?x=1")),
        (4, "http://b.com/fr/allowed", link.format("http://other.net/q")), (5, "http://far.net/r", '<meta http-equiv="Refresh" content="0; url=/r2">'), (6, "http://far.net/r2", ""), (7, None, None), (8, "no scheme", ""),
        (9, "HTTP://Sub.Example.ORG", ""), (10, "http://example.org/en/12", ""), (11, "http://c.net/", "<!-- " + link.format("http://a.example.org/es/x") + " -->"), (12, "http://c.com/de/x", None),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_pages(page(spark, rows)).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("plain.net", "/p", None, "block") and got[3][3] == "block"
    assert got[4] == ("b.com", "/fr/allowed", "com/fr/", "allow")
    assert got[5][3] == got[6][3] == "allow" and got[7] == ("", "", None, "allow") == got[8]
    assert got[9] == ("sub.example.org", "", None, "allow") and got[10][2:] == ("example.org/en/1", "block") and got[11][3] == "allow" and got[12][2:] == ("com/de/", "block")
    redirects = spark.createDataFrame([("http://far.net/r2", "http://c.com/de/x")], "src string, dst string")
    more = {r["page_id"]: r["verdict"] for r in url_filters.judge_pages(page(spark, rows), redirects=redirects).collect()}
    assert more[5] == more[6] == "block" and more[11] == "allow"
    assert url_filters.judge_pages(page(spark, [])).count() == 0


def test_dot_segments_of_links(spark):
    link = '<link rel="canonical" href="{}">'
    cases = {"../a.html": "/x/a.html", "./a.html": "/x/y/a.html", "../../../a": "/a", "b/./c/../d?p=../q#../f": "/x/y/b/d?p=../q#../f", "..": "/x/", "/m/../n/.": "/n/", "//h.net/k/../l": None, "a..b/.c": "/x/y/a..b/.c", "../../..//z": "//z"}
    rows = [(i, f"http://h.net/x/y/p{i}", link.format(h)) for i, h in enumerate(cases)]
    got = {r["src"]: r["dst"] for r in url_filters.page_links(page(spark, rows)).collect()}
    assert [got[u] for _, u, _ in rows] == ["http://h.net" + (w or "/l") for w in cases.values()]
    pages = page(spark, [(1, "http://c.com/de/x", ""), (2, "http://c.com/q/r/s", link.format("../../de/./x"))])
    assert {r["verdict"] for r in url_filters.judge_pages(pages).collect()} == {"block"}


def test_exact_dedup(spark, odd):
    ids = [*range(len(odd) - 2), None, None]
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {}
    for i, t in zip(ids, odd, strict=True):
        want.setdefault(norm(t), []).append(i)
    for all_of in (True, False):
        got = exact_dedup.exact_dedup(docs(spark, odd, ids, True), digest_all=all_of).collect()
        assert len(got) == len(odd)
        for r in got:
            if r["doc_id"] is None:
                continue
            group = want[norm(odd[r["doc_id"]])]
            least = min(x for x in group if x is not None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(group), r["doc_id"] == least)
            if all_of or len(group) > 1:
                assert r["text_sha256"] == hashlib.sha256(norm(odd[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, []), True).count() == 0


def test_repeated_runs_go_whole(spark, odd):
    rng = random.Random(14)
    line = lambda: " ".join(rng.choice(["red", "blue", "green", "x", "y"]) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 3, 9, 14])))
    shared = [[line() for _ in range(n)] for n in (2, 3, 4, 6, 9)]
    texts = [*odd, "same long line of eight words or more\n" * 5, "a b c d e\nf g h i\n\nj k\nend"]
    for k in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else [line() for _ in range(3)] for _ in range(3)]
        cut = [x for p in parts for x in (p if rng.random() < 0.7 else p[:2])]
        texts.append("\n".join(cut))
    split = [(t or "").split("\n") for t in texts]
    first, gone = {}, [set() for _ in texts]
    for i, x in enumerate(split):  # every run of lines that ends are not blank, from the longest lists down
        n = [len(y.split()) for y in x]
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                if n[a] and n[b] and sum(map(bool, n[a : b + 1])) >= line_dedup.MIN_LINES and sum(n[a : b + 1]) >= line_dedup.MIN_WORDS:
                    d, e = first.setdefault(tuple(x[a : b + 1]), (i, b))
                    if d < i or e < a:
                        gone[i].update(range(a, b + 1))
    assert sum(map(len, gone)) > 100
    for bits in (64, 6):  # six bits: nearly every hash clashes, so bytes decide
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts, extra=True), report=True, hash_bits=bits).collect()}
        want, all_lines, found_lines = chunk_runs(texts, bits), 0, 0
        for i, x in enumerate(split):
            raw = (texts[i] or "").encode()
            keep, lines = raw, set()
            for begin, stop in reversed(want[i]):
                keep = keep[:begin] + keep[stop + 1 :]
                lines.update(range(raw.count(b"\n", 0, begin), raw.count(b"\n", 0, stop) + 1))
            assert ((got[i]["text"] or "").encode(), got[i]["_n_removed_lines"], got[i]["_n_removed_chunks"]) == (keep, len(lines), len(want[i])), i
            assert lines <= gone[i], i  # nothing goes that isn't in a repeated run
            all_lines, found_lines = all_lines + len(gone[i]), found_lines + len(lines)
        assert found_lines >= 0.9 * all_lines  # and only runs without a boundary stay
        assert got[0]["text"] is None
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def chunk_runs(texts, bits):
    """(begin, stop) of the runs to remove per text, window by window and by bytes."""
    found = [line_dedup.windows((t or "").encode(), bits) for t in texts]
    chunks = [h for w in found for *_, h, cut in w if cut]
    marked = [any(cut and chunks.count(h) > 1 for *_, h, cut in w) for w in found]
    first, out = {}, []
    for i, (t, w) in enumerate(zip(texts, found, strict=True)):
        runs = []
        for begin, stop, _, cut in w if marked[i] else []:
            d, e = first.setdefault((t or "").encode()[begin:stop], (i, stop))
            if d < i or e < begin:
                if runs and begin <= runs[-1][1] + 1:
                    runs[-1] = [runs[-1][0], max(stop, runs[-1][1]), runs[-1][2] or cut]
                else:
                    runs.append([begin, stop, cut])
        out.append([(a, b) for a, b, cut in runs if cut])
    return out


def test_line_dedup_of_repeated_and_missing_ids(spark):
    run = "first line of some words\nsecond line of some words"
    rows = [(3, "x\n" + run), (3, "y\n" + run), (None, run + "\nz"), (None, run + "\nz"), (None, "w\n" + run), (7, run), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_id", "_marks", "_n_lines", "row", "o", "marks", "t", "col")})
    got = line_dedup.dedup_lines(df, report=True)
    assert got.columns == [c for c in df.columns if c != "_n_lines"] + list(line_dedup.REPORT)
    assert any(cut for *_, cut in line_dedup.windows(run.encode()))  # this run has a boundary
    texts = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(x for x in texts if x[0] == 3) in ([(3, "x\n"), (3, "y\n" + run)], [(3, "x\n" + run), (3, "y\n")])  # documents of their own: one of them is first
    assert sorted((x for x in texts if x[0] != 3), key=repr) == sorted([(7, ""), (8, ""), (None, None), (None, "w\n"), (None, "z"), (None, "z")], key=repr)
    assert all(r["_id"] == "_id" and r["col"] == "col" for r in got.collect())


def test_rows_of_one_id_with_other_layouts(spark):
    """Marks of one row never cut another row's text."""
    run = "first line of some words\nsecond line of some words\nthird line of some words"
    other = "nothing in common\nwith any other text here at all\nthree lines of words stand here"
    rows = [(1, run), (2, "a head line that is long enough to shift\n" + run), (2, other), (2, other), (2, run + "\n" + other.upper())]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, run), (2, "a head line that is long enough to shift\n"), (2, other), (2, other), (2, other.upper())])


def test_boundaries_are_chosen_by_the_rolling_hash():
    """Some windows are chunks, most are; which ones depends on their own lines only; runs of four lines seldom have none."""
    rng = random.Random(8)
    lines = [f"line of some words {rng.random()}" for _ in range(2000)]
    text = "\n".join(lines).encode()
    chosen = {text[a:b] for a, b, _, cut in line_dedup.windows(text) if cut}
    every = {text[a:b] for a, b, _, _ in line_dedup.windows(text)}
    assert 0.8 < len(chosen) / len(every) < 0.95
    moved = "\n".join(["new", *lines[:900], "inserted", *lines[900:]]).encode()
    again = {moved[a:b] for a, b, _, cut in line_dedup.windows(moved) if cut}
    assert again & every == chosen & {moved[a:b] for a, b, _, _ in line_dedup.windows(moved)}
    has = [any(cut for *_, cut in line_dedup.windows("\n".join(lines[i : i + 4]).encode())) for i in range(0, 2000, 4)]
    assert sum(has) >= 0.98 * len(has)


def test_chunk_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [f"line of some words {rng.random()}" for _ in range(200)]
    a = {h for *_, h, _ in line_dedup.windows("\n".join(lines).encode())}
    b = {h for *_, h, _ in line_dedup.windows("\n".join(["new", *lines[:90], "inserted", *lines[90:]]).encode())}
    assert len(a & b) >= len(a) - 4


def test_suffix_dedup(spark, odd):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs(spark, odd, extra=True)).collect()}
    first = {}
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(raw), int(gone.sum()), runs, kept), i
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0


def test_merged_transforms_sort_like_suffixes():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 90))) for _ in range(60)]
    strings += [s[5:70] for s in strings[:20] if len(s) >= 70]
    owner = np.arange(len(strings))
    suffix_dedup.SHARD, old = 1000, suffix_dedup.SHARD
    try:
        got = suffix_dedup.least_owner(strings, owner)
    finally:
        suffix_dedup.SHARD = old
    first = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 49):
            first.setdefault(s[k : k + 50], i)
    assert [x.tolist() for x in got] == [[first[s[k : k + 50]] for k in range(len(s) - 49)] for s in strings]


def test_mixing(spark, odd):
    rng = random.Random(4)
    texts = [" ".join("w" for _ in range(rng.randint(0, 60))) for _ in range(900)] + [None, ""]
    df = spark.createDataFrame([(i, t, None if i % 6 == 0 else "abcde"[i % 5]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(texts) and got and {tuple(r) for r in mixing.mix(df.repartition(7)).collect()} == {tuple(r) for r in got}
    by = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["size"] == len((texts[r["doc_id"]] or "").split())
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    targets = {s: rows[0]["target"] for s, rows in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    names = sorted(s for s in by if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free = [s for s in names if targets[s] < 2 * by[s][0]["source_size"] - 1e-6]
    assert len({round(targets[s] / weight[s], 6) for s in free}) <= 1
    for s, rows in by.items():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"] and abs(sum(r["taken"] for r in rows) - targets[s]) <= 60
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, odd, extra=True)).count() == len(odd)


def brute_copies(rows, targets):
    """Copies by id of rows (id, source, size), one source after another, by the definition."""
    out = {}
    for s, target in targets.items():
        mine = [(i, n, int(n**0.5)) for i, t, n in rows if t == s]
        lo, hi = 0.0, 1e6
        for _ in range(200):
            level = (lo + hi) / 2
            lo, hi = (level, hi) if sum(n * min(2, level * w) for _, n, w in mine) < target else (lo, level)
        c = {i: min(2, lo * w) for i, n, w in mine}
        out |= {i: int(c[i] + 1e-9) for i, _, _ in mine}
        budget = target - sum(n * out[i] for i, n, _ in mine)
        u = {i: (int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i, _, _ in mine}
        order = sorted((u[i] / (1 - u[i]) / (p / (1 - p)), i, n) for i, n, _ in mine if n and (p := c[i] - out[i]) > 1e-9)
        upto = 0
        for _, i, n in order:
            upto += n
            if upto - budget <= budget - (upto - n):
                out[i] += 1
    return out


def test_copies_by_inclusion_odds(spark):
    rng = random.Random(21)
    rows = [(i, "abc"[min(2, int(rng.expovariate(1)))], int(rng.paretovariate(0.9)) % 4000) for i in range(1500)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, s, n in rows], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    want = brute_copies(rows, {r["source"]: r["target"] for r in got})
    assert {r["doc_id"]: r["copies"] for r in got if r["size"]} == {i: want[i] for i, _, n in rows if n}
    assert {r["copies"] for r in got} == {0, 1, 2}
    wide = df.withColumns({c: F.lit(c) for c in ("_id", "_source", "copies", "col", "row", "name", "n", "w", "level", "rank")})
    mixed = mixing.mixed_rows(wide)
    assert mixed.columns == wide.columns and {(r["doc_id"], r["count"]) for r in mixed.groupBy("doc_id").count().collect()} == {(r["doc_id"], r["copies"]) for r in got if r["copies"]}
    nameless = spark.createDataFrame([(None, f"some words {i % 40} of it", None) for i in range(200)], "doc_id long, text string, source string")
    assert mixing.mix(nameless).count() == 200 and mixing.mixed_rows(nameless.limit(0)).count() == 0


def test_secret_spans(spark, odd):
    rng = random.Random(6)
    key = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    b64 = secrets.ALPHABETS["base64"]
    base = [f"é text {key(40, b64)} more" for _ in range(30)] + ["word " + key(30, "abcdefgh") for _ in range(60)] + ["aVeryLongCamelCaseIdentifierName and other_snake_case_identifier_words"] * 20
    base += ['token = "abc123" api-key=zz9999 APIKEY: qwerty1', "AKIA" + "A" * 16, "x" + "0123456789abcdef" * 2, None, "", "password = short"[:15]]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in secrets.scan_secrets(docs(spark, base, extra=True)).collect()}
    n = len(base)
    assert len(got) == n and [k for *_, k in got[n - 6]] == ["assign", "assign"] and got[n - 5] == [(0, 20, "access")] and got[n - 4] == [(1, 33, "hex")] and got[n - 3] == got[n - 2] == []
    assert sum(any(k == "random" for *_, k in got[i]) for i in range(30)) >= 27
    assert not any(k == "random" for i in range(30, 110) for *_, k in got[i])
    assert all(base[i][a:b] in base[i].split() for i in range(30) for a, b, k in got[i] if k == "random")
    assert secrets.scan_secrets(docs(spark, odd)).count() == len(odd) and secrets.scan_secrets(docs(spark, [])).count() == 0


def test_fingerprints_and_groups(spark, odd):
    def slow(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [slow(t) for t in odd]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(docs(spark, odd, extra=True)).collect()}
    roots = brute_components(fps)
    assert [got[i] for i in range(len(odd))] == list(zip(fps, roots, strict=True))
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_stage_keeps_one_of_similar_texts(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(900)]
    texts = []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        texts.append(" ".join(base))
        for _ in range(k % 3):
            near = list(base)
            for _ in range(rng.randint(1, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    crowd = [rng.choice(vocabulary) for _ in range(200)]
    texts += [" ".join([*crowd[:190], f"tail{k}"]) for k in range(120)] + [None, "", " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or (len(x & y) * 10 >= 8 * len(x | y) > 0):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["o"]["id"]: r["keep"]["id"] for r in simhash.similar_groups(docs(spark, texts)).collect()}
    want = {i: root(i) for i in range(len(texts))}
    assert sum(got[i] != want[i] for i in want) <= 3 and all(root(got[i]) == want[i] for i in want)
    assert len({got[i] for i in range(len(texts) - 3 - 120, len(texts) - 3)}) == 1 and got[len(texts) - 1] == len(texts) - 3
    assert {r["doc_id"] for r in simhash.keep_one_similar(docs(spark, texts)).collect()} == set(got.values())
    assert simhash.keep_one_similar(docs(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [4096, 24])
def test_texts_of_one_key_all_meet(spark, monkeypatch, crowd):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(700)]
    core = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for k in range(110):  # all share a core, too little to be similar by it
        base = core + [rng.choice(vocabulary) for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(k % 3):
            near = list(base)
            for _ in range(rng.randint(1, 4)):  # about 0.72 to 0.93
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    parts = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 10 * len(x & y) >= 8 * len(x | y) and parts[i] != parts[j]:
                low, high = sorted((parts[i], parts[j]))
                parts = [low if p == high else p for p in parts]
    monkeypatch.setattr(simhash, "STAGE_CROWD", crowd)
    monkeypatch.setattr(simhash, "stage_keys", lambda h, tables: np.array([7], np.uint64))  # closures carry it to the workers
    got = {r["o"]["id"]: r["keep"]["id"] for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parts


def test_one_of_equal_rows_stays(spark, odd):
    rows = [(2, odd[5]), (2, odd[5]), (2, odd[6]), (9, odd[5].upper()), (None, odd[16]), (None, odd[16]), (None, None), (3, "")]
    names = ("_stay", "o", "row", "n", "k", "node")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    got = simhash.keep_one_similar(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept)) == sorted([(2, odd[5]), (2, odd[6]), (0, odd[16]), (3, "")])
    assert all(r[c] == c for r in kept for c in names)


def test_golay_keys_meet_all_pairs():
    rng = random.Random(1)
    tables = simhash.golay_tables()
    a = np.array([rng.getrandbits(64) for _ in range(800)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
            b[i] ^= np.uint64(1 << bit)

    def keys(fp):
        out = {}
        for r, f, k in zip(*(x.tolist() for x in simhash.segment_keys(fp, tables)), strict=True):
            out.setdefault(r, set()).add((f, k))
        return out

    x, y = keys(a), keys(b)
    assert all(x[i] & y[i] for i in range(len(a)))


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    near = {base} | {base ^ sum(1 << b for b in rng.sample(range(10), rng.randint(1, 4))) for _ in range(150)}
    far = {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(near | far)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parts = {r["node"] % (1 << 64): r["component"] for r in connected_components(simhash.near_links(df), "a", "b").collect()}
    roots = brute_components(fps)
    names = {}
    for f, r in zip(fps, roots, strict=True):
        if f in parts:
            assert names.setdefault(parts[f], r) == r
        else:
            assert roots.count(r) == 1
    assert len(set(names.values())) == len(names)


def test_quality_measures(spark, odd):
    texts = [*odd, "x y z w v u t s " * 3 + "end", "a # $b\n\n same line\n same line\nother"]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(grams) < 3000 else set()
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")) == want
        if len(grams) < 3000:
            assert got[i]["n_repeat_words"] == len(cover)
            assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def test_sketch_buckets(spark):
    xs = [*range(0, 300), 1000, 12345, 1 << 40]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", quality_rules.bucket_value(quality_rules.bucket(F.col("x"))).alias("v"))
    assert all(r["v"] <= r["x"] <= r["v"] * 33 / 32 + 1 and (r["x"] >= 64 or r["v"] == r["x"]) for r in df.collect())


def test_adaptive_rules_drop_outliers_only(spark):
    rng = random.Random(9)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(90)) for _ in range(60)) for _ in range(150)]
    junk = [" ".join(f"w{rng.randrange(999)}###" for _ in range(60)) for _ in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 155))


def test_classifier_on_held_out_rows(spark, odd):
    rng = random.Random(10)
    good = [" ".join(rng.choice(["the", "and", "over", "water", "stone", "river"]) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(rng.choice(["the", "and", "over", "water", "stone", "river"]) + rng.choice(["###", "$$$"]) for _ in range(40)) for _ in range(100)]
    df = docs(spark, good + bad + odd, extra=True)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(df, labels).collect()}
    assert len(got) == 400 + len(odd) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert sum(got[i]["predicted"] == int(i < 300) for i in held) / len(held) > 0.95
    none = quality_classifier.classify(docs(spark, odd), labels.limit(0)).collect()
    assert len(none) == len(odd) and {r["score"] for r in none} == {0.5}
    kept = quality_classifier.accepted(df, quality_classifier.fit(df, labels))
    assert kept.columns == df.columns and kept.where("doc_id between 300 and 399").count() < 5


def test_accepted_rows_keep_columns_of_any_name(spark):
    model = quality_classifier.fit(docs(spark, ["a b c", "d e f"]), spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    df = docs(spark, ["some words", None]).withColumns({"a.b": F.lit(1), "c`d": F.lit(2), "row": F.lit(3), "x": F.lit(4)})
    got = quality_classifier.accepted(df, model, threshold=0.0)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.select(F.col("`a.b`"), "row", "x").collect()) == [(1, 3, 4)] * 2


def test_held_out_labels_are_never_read(spark):
    texts = [("good word " if i % 2 else "bad### ") * 20 for i in range(200)]
    labels = [(i, i % 2, 0) for i in range(200)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({(r["doc_id"], r["score"]) for r in quality_classifier.classify(docs(spark, texts), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_neighbour_sums_and_pooling(spark):
    """Against slow sums word by word; blocks cut long texts without changing them."""
    rng = random.Random(31)
    texts = [" ".join(rng.choice(["Alpha", "beta", "g-7", "x" * 90, "x" * 91, "DELTA"]) for _ in range(rng.randrange(40))) for _ in range(30)]
    q = quality_classifier
    index = q.index_vectors()
    want, terms = np.zeros((q.BUCKETS, q.DIMS)), q.Terms()
    for t in texts:
        x = terms(t)
        for i in range(len(x)):
            for j in range(max(0, i - q.WINDOW), min(len(x), i + q.WINDOW + 1)):
                for k in (0, 1):
                    if i != j:
                        want[x[i, k]] += index[x[j, k]]
    old = q.BLOCK_WORDS
    try:
        for q.BLOCK_WORDS in (old, 7):
            assert (q.neighbour_sums(iter(texts), index) == want).all()
    finally:
        q.BLOCK_WORDS = old
    assert q._word_terms("a1" * 40 + "!") != q._word_terms("a1" * 40 + "?")
    vectors = q.word_vectors(want, index)
    for t in texts:
        x = terms(t)
        slow = np.concatenate([np.mean([vectors[b] for b in x[:, k]], axis=0) for k in (0, 1)]) if len(x) else np.zeros(2 * q.DIMS)
        assert np.allclose(q.pooled(t, vectors, q.Terms())[:-1], slow, atol=1e-5)


def test_training_takes_one_row_of_an_id(spark):
    rows = [(1, "good words here"), (2, "bad### words###")] * 300 + [(i, "good words") for i in range(3, 40)]
    labels = [(i, int(i != 2), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_classifier.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_fences_follow_their_group(spark):
    """Two sources with different usage get different fences; a shift of one moves its own, not the other's."""
    rng = random.Random(17)

    def fences(shift, of_code=400):
        texts = []
        for source, words, n in (("wiki", 3, 400), ("code", 3 + shift, of_code)):
            texts += [(source, " ".join("w" * max(1, int(rng.gauss(words, 0.5))) + str(rng.randrange(10)) + "#" * (source == "code" and rng.random() < 0.3) for _ in range(50))) for _ in range(n)]
        df = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
        sketch = quality_rules.sketches(quality_rules.measures(quality_rules.features(df)))
        return {r["sn"]: r.asDict(True) for r in quality_rules.fences(sketch).collect()}

    one, two = fences(0), fences(6)
    assert one["vcode"]["f_m_symbols"]["hi"] > 200 + one["vwiki"]["f_m_symbols"]["hi"]
    assert two["vcode"]["f_m_word_length"]["lo"] > one["vcode"]["f_m_word_length"]["hi"]
    assert abs(two["vwiki"]["f_m_word_length"]["lo"] - one["vwiki"]["f_m_word_length"]["lo"]) <= 40
    few = fences(6, 3)  # three documents hardly move their language's cutoffs
    assert abs(few["vcode"]["f_m_word_length"]["hi"] - few["vwiki"]["f_m_word_length"]["hi"]) <= 60


def test_base_spans_by_brute_force():
    """Every start and end, leftmost and greedy, without the patterns."""
    rng = random.Random(44)
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

    def runs(text, chars, head=""):
        out, i = [], 0
        while i < len(text):
            j = i + len(head)
            if text.startswith(head, i) and j < len(text) and text[j] in chars:
                while j < len(text) and text[j] in chars:
                    j += 1
                out.append((i, j))
                i = j
            else:
                i += 1
        return out

    def assigns(text):
        out, i = [], 0
        while i < len(text):
            end = None
            for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if text[i : i + len(key)].isascii() and text[i : i + len(key)].lower() == key:
                    j = i + len(key)
                    j += text[j : j + 1] in ("'", '"') and j < len(text)
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] in (":", "="):
                        j += 1
                        while text[j : j + 1] == " ":
                            j += 1
                        j += text[j : j + 1] in ("'", '"') and j < len(text)
                        k = j
                        while k < len(text) and text[k] in word:
                            k += 1
                        if k > j:
                            end = (k, k - j)
            if end:
                out.append((i, end[0], end[1]))
                i = end[0]
            else:
                i += 1
        return out

    pieces = ["token", "Secret", "API_KEY", "apikey", "passwd", ":", "=", " ", "'", '"', "abc123", "zz", "é", "\n", "AKIA", "A" * 16, "0123456789abcdef", "deadbeef" * 2, "tokentoken=", "x.y=="]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        want = [(a, 0, b) for a, b, n in assigns(t) if n >= 6]
        want += [(a, 1, b) for a, b in runs(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA") if b - a >= 20]
        want += [(a, 2, b) for a, b in runs(t, "0123456789abcdef") if b - a >= 24]
        assert secrets.base_spans(t) == sorted(want), t


def test_battery_and_discovery(spark):
    """p-values are uniform on random tokens; recall by encoding and length; Benjamini-Hochberg by definition; linear time."""
    rng = np.random.default_rng(3)
    for name, n in (("base64", 24), ("base32", 40), ("hex", 300), ("base62", 300)):
        p = secrets.uniform_tests(rng.integers(0, len(secrets.ALPHABETS[name]), (2000, n)), name)
        assert ((p < 0.1).mean(axis=1) < 0.14).all() and (p < 0.01).mean() < 0.025
    r = random.Random(4)
    for name, n in (("base64", 40), ("base62", 40), ("base32", 52), ("lower32", 64), ("base36", 40), ("base64", 88)):
        chars = secrets.ALPHABETS[name]
        found = [secrets.candidates("".join(r.choice(chars) for _ in range(n)), []) for _ in range(100)]
        assert sum(bool(f) and f[0][4] and f[0][3] >= 20 for f in found) >= 75, name
    rows = [(1, b, i) for i, b in enumerate([30, 30, 21, 20, 19, 5, 0, 0, 0, 0])] + [(2, 12, 99)]
    cut = {x["class"]: x["cut"] for x in secrets.cutoffs(spark.createDataFrame(rows, "class int, bin int, n int"), 0.05).collect()}
    ps = sorted((10 ** (-b / 10), b) for c, b, _ in rows if c == 1)
    assert cut == {1: min(b for i, (p, b) in enumerate(ps) if p <= 0.05 * (i + 1) / len(ps))}
    text = " ".join("0123456789abcdef" * 2 for _ in range(100_000))
    base = secrets.base_spans(text)
    assert len(base) == 100_000 and secrets.candidates(text, base) == []


def test_shards_and_frequent_passages(spark, monkeypatch):
    rng = random.Random(50)
    para = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    shards, merge = [], suffix_dedup.merge_transforms
    monkeypatch.setattr(suffix_dedup, "merge_transforms", lambda t, n: shards.append(len(t)) or merge(t, n))
    passage = para(400)
    texts = [para(60) + passage[rng.randrange(60) : 340 + rng.randrange(60)] + para(60) for _ in range(300)]
    blobs = list(suffix_dedup._pack(list(range(300)), [0] * 300, [0] * 300, texts, 4))
    sent = sum(suffix_dedup._unpack([x])[0]["doc"].size for _, x in blobs if x[:1] == suffix_dedup._FRAGMENTS)
    unsent = suffix_dedup.fragments(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))[0].size
    assert sent < 0.7 * unsent  # inner fragments of the passage are sent once
    flags = [suffix_dedup._unpack_runs(x) for _, x in blobs if x[:1] == suffix_dedup._RUNS]
    by: dict[int, list[bytes]] = {}
    for k, x in blobs:
        if x[:1] == suffix_dedup._FRAGMENTS:
            by.setdefault(k, []).append(x)
    flags += [suffix_dedup._bucket_rows(x) for x in by.values()]
    got = {(d, i) for docs_, _, firsts, lasts in flags for d, a, b in zip(docs_, firsts, lasts, strict=True) for i in range(a, b + 1)}
    first, want = {}, set()
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], d) < d:
                want.add((d, i))
    assert got == want and max(shards) >= 5


def repeated_bytes(rows):
    """(bytes, removed, spans, kept) of each (doc, text), by brute force over all 50-byte strings; no doc counts as the largest."""
    of = lambda d: (d is None, d or 0)
    least = {}
    for d, t in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], of(d)), of(d))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < of(d):
                gone[k : k + 50] = True
        out.append((len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("ids_repeat", [False, True])
def test_whole_copies_are_set_aside(spark, monkeypatch, ids_repeat):
    rng = random.Random(51)
    para = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    base = [para(rng.randint(40, 300)) for _ in range(20)]
    texts = base * 4 + [base[0] + para(70) + base[1], para(30) + base[2][20:] + base[3], "", para(49), "a" * 50, "a" * 50]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = None  # the largest, with copies of its text in other rows
    ids[80] = 1000
    rows = [*zip(ids, texts, strict=True), (1000, "short text of an id that loses bytes")]
    if ids_repeat:
        rows += [(ids[20], texts[20]), (ids[21], texts[22] + "x"), (ids[22], base[5]), (None, texts[3])]
    rows = [(d, t.encode()) for d, t in rows]
    sent, find = [], suffix_dedup.repeated_starts
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda x: sent.append(x.count()) or find(x))
    got = suffix_dedup.suffix_dedup(docs(spark, [t.decode() for _, t in rows], ids=[d for d, _ in rows]))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"], [tuple(s) for s in r["spans"]]) for r in got.collect()), key=key)
    want = sorted(((d, *x) for (d, _), x in zip(rows, repeated_bytes(rows), strict=True)), key=key)
    assert [r[:5] for r in got] == want
    assert all(r[5] == hashlib.sha256(r[4]).hexdigest() and len(r[6]) == r[3] and sum(b - a for a, b in r[6]) == r[2] for r in got)
    assert sent[0] <= 30  # of 80 copies and more, each text is sent once


def test_merges_do_not_grow_with_a_bucket(monkeypatch):
    rng = random.Random(52)
    para = lambda n: bytes(rng.choices(b"abcdefghij ", k=n))
    sizes, merge = [], suffix_dedup.merge_transforms
    monkeypatch.setattr(suffix_dedup, "merge_transforms", lambda t, n: sizes.append(sum(map(len, t))) or merge(t, n))
    passages = [para(110) for _ in range(1200)]
    rows = [(d, para(60) + passages[d % 1200] + para(60)) for d in range(3000)]
    blobs = [x for a in (0, 1500) for _, x in suffix_dedup._pack(*map(list, zip(*((d, 0, 0, t) for d, t in rows[a : a + 1500]), strict=True)), 1)]
    flags = [suffix_dedup._unpack_runs(x) for x in blobs if x[:1] == suffix_dedup._RUNS] + [suffix_dedup._bucket_rows([x for x in blobs if x[:1] == suffix_dedup._FRAGMENTS])]
    got = {(d, i) for d_, _, firsts, lasts in flags for d, a, b in zip(d_, firsts, lasts, strict=True) for i in range(a, b + 1)}
    least, want = {}, set()
    for d, t in rows:
        for i in range(len(t) - 49):
            if least.setdefault(t[i : i + 50], d) < d:
                want.add((d, i))
    assert got == want and sum(sizes) > 150_000 and max(sizes) < 80_000


def test_runs_that_touch_are_one():
    run = lambda *x: tuple(np.array(y, np.int64) for y in zip(*x, strict=True))
    got = suffix_dedup._merged_runs(*run((0, 200, 210), (0, 0, 10), (0, 60, 70), (2, 5, 5), (2, 0, 100), (2, 151, 152)))
    assert list(zip(*map(list, got), strict=True)) == [(0, 0, 120), (0, 200, 260), (2, 0, 150), (2, 151, 202)]
    assert [len(x) for x in suffix_dedup._merged_runs(*[np.zeros(0, np.int64)] * 3)] == [0, 0, 0]

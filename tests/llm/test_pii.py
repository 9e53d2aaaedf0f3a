import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from petrel.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@pytest.fixture(scope="module")
def texts():
    """Pieces that run into each other, code points beyond 16 bits, nulls, long runs."""
    rng = random.Random(13)
    parts = ["a@b.c", "_d@e.f", "x.y%z+q@mail-1.example.com", "@", ".", "a@b", "1.2.3.4", "5.6", "256.1.1.1", "000255.0.00.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "12 34", "+1 (524) 555-7373", "+49", "+", "7", "-", " ", "\n", "é", "😀", "word", "(", ")", "٣", "9999999999999999999"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    out += [None, "", " ", "1" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "+1" + " " * 20_000, "x@y.z " * 3000, "." * 20_000, "1.2.3.4 " * 700 + "a@b.cc"]
    return out + [out[0]] * 3


def test_fixed_spans_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, kind int")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"] if x["kind"] in pii.KINDS[: pii.BASE]] for r in pii.find_pii(df).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}


def test_query_columns(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_pii(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")], ("base_sha256", "string"), ("spans", "string")]
    for r in out.collect():
        want = brute(texts[r["doc_id"]] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [Counter(k for k, _, _ in want)[k] for k in ("email", "ip", "card", "phone")]


def slow_law(patterns, rounds):
    """Expectation-maximisation over single votes."""
    kinds, labelers = len(pii.KINDS), pii.LABELERS
    prior, yes, no = [0.5] * kinds, [[0.1, 0.2, 0.7] for _ in range(labelers)], [[0.4, 0.4, 0.2] for _ in range(labelers)]
    for _ in range(rounds):
        real = []
        for kind, votes, n in patterns:
            a = prior[kind] * math.prod(yes[j][v + 1] for j, v in enumerate(votes))
            b = (1 - prior[kind]) * math.prod(no[j][v + 1] for j, v in enumerate(votes))
            real.append(n * a / (a + b))
        rows = list(zip(patterns, real, strict=True))
        prior = [(1 + sum(y for (k, _, _), y in rows if k == kind)) / (2 + sum(n for k, _, n in patterns if k == kind)) for kind in range(kinds)]
        all_yes, all_no = sum(real), sum(n - y for (_, _, n), y in rows)
        yes = [[(1 + sum(y for (_, v, _), y in rows if v[j] == s - 1)) / (3 + all_yes) for s in range(3)] for j in range(labelers)]
        no = [[(1 + sum(n - y for (_, v, n), y in rows if v[j] == s - 1)) / (3 + all_no) for s in range(3)] for j in range(labelers)]
    return prior, sum(yes, []), sum(no, [])


def test_reliabilities_equal_a_slow_run(spark):
    rng = random.Random(4)
    seen = Counter((rng.randrange(7), tuple(rng.choice((-1, 0, 0, 1, 1)) for _ in range(5))) for _ in range(3000))
    patterns = [(k, list(v), n) for (k, v), n in seen.items()]
    law = pii.reliabilities(spark.createDataFrame(patterns, "kind int, votes array<int>, n long").repartition(3)).first()["law"]
    prior, yes, no = slow_law(sorted(patterns), pii.ROUNDS)
    assert list(law["prior"]) == pytest.approx(prior) and list(law["yes"]) == pytest.approx(yes) and list(law["no"]) == pytest.approx(no)


def test_reliable_labelers_are_told_from_noise(spark):
    """Four labelers follow a hidden truth nine times in ten, one is a coin."""
    rng = random.Random(9)
    seen = Counter()
    for _ in range(6000):
        real = rng.random() < 0.4
        follow = lambda: (1 if real else -1) * (1 if rng.random() < 0.9 else -1)
        seen[(rng.randrange(2), (follow(), follow(), rng.choice((-1, 1)), follow(), follow()))] += 1
    law = pii.reliabilities(spark.createDataFrame([(k, list(v), n) for (k, v), n in seen.items()], "kind int, votes array<int>, n long")).first()["law"]
    assert all(abs(law["yes"][3 * j + 2] - 0.9) < 0.03 and abs(law["no"][3 * j + 2] - 0.1) < 0.03 for j in (0, 1, 3, 4))
    assert abs(law["yes"][8] - 0.5) < 0.05 and abs(law["prior"][0] - 0.4) < 0.05


def test_votes_add_spans_and_leave_numbers_alone(spark):
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [f"write to u{i}@mail{i % 9}.example.com or call +1 (5{digits(2)}) 555-{digits(4)} now" for i in range(200)]
    rows += [f"call 030 555 {digits(4)} today" for _ in range(40)] + [f"contact jo{i} [at] example [dot] com please" for i in range(40)]
    rows += [f"version {rng.randrange(9)}{rng.randrange(10, 99)}.{digits(2)}.{digits(2)}1 of the page" for _ in range(80)] + ["order 2019-10-1177 shipped" for _ in range(30)]
    out = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(out[i] == ["email", "phone"] for i in range(200))
    assert all(out[i] == ["number"] for i in range(200, 240)) and all(out[i] == ["mail"] for i in range(240, 280))
    assert not any(out[i] for i in range(280, 390))


def test_wide_spans_keep_clear_of_fixed_ones(spark):
    text = "+1 (524) 555-7373 and 030 555 1234, 1.2.3.4, (030) 555 1234"
    got = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    fixed = [(a, b) for _, a, b in brute(text)]
    assert [(x["start"], x["end"]) for x in got["wide"]] == [(m.start(), m.end()) for m in re.finditer(r"\(?030\)? 555 1234", text)]
    assert all(b <= x["start"] or a >= x["end"] for x in got["wide"] for a, b in fixed)


def test_running_folds(spark):
    xs = [random.Random(1).randrange(9) for _ in range(700)]
    row = spark.range(1).select(pii.running(F.array(*[F.lit(x) for x in xs[:70]]), lambda a, b: a + b, 8).alias("a"), pii.running(F.array().cast("array<int>"), lambda a, b: a + b).alias("b")).first()
    assert list(row["a"]) == [sum(xs[: i + 1]) for i in range(70)] and row["b"] == []


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0

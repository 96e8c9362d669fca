"""Importance resampling, phrase growth and personal data against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import importance_resampling as R
from barloom.llm import phrase_growth as P
from barloom.llm import pii_boosting as B
from barloom.llm import queries as Q

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# importance resampling

def slow_features(text, lo, hi):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    return len(w), [" ".join(w[i:i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def slow_draw(docs, target, rule):
    own = [(i, *slow_features(t, rule.shortest, rule.longest)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % rule.buckets
    s = collections.Counter(bucket(f) for *_, fs in own for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in slow_features(x, rule.shortest, rule.longest)[1])
    big_s, big_t = sum(s.values()) + rule.buckets, sum(t.values()) + rule.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    rows = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"{rule.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= rule.least_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    return rows, able[:rule.percent * len(able) // 100]


@pytest.mark.parametrize("rule", [R.Resampling(least_words=3, percent=40, buckets=50), R.Resampling(1, 2, buckets=200, least_words=2, percent=100, seed="x")])
def test_draw_equals_plain_one(spark, rule):
    rng = random.Random(1)
    words = ["The", "fox", "É", "a1", "x.y", "-", "漢字", "Zoo", "\x00", "the"]
    docs = [(rng.choice([None, i, -i, i * 10**15]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))])) for i in range(300)]
    docs += docs[:20]
    target = [None, "the fox the fox zoo", "a1 漢字"]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, score int")
    got = R.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), rule, chunk_rows=17).collect()
    rows, drawn = slow_draw(docs, target, rule)
    key = lambda r: tuple(-10**30 if v is None else v for v in r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(((i, n, w, s) for i, _, n, w, s in rows), key=key)
    ranks = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [(r[1], r[2]) for r in ranks] == [(s, i) for i, *_, s in drawn] and [r[0] for r in ranks] == list(range(1, len(drawn) + 1))


@pytest.mark.parametrize("ids", [[5] * 40, [-2**63, 2**63 - 2, 0, None, -1, 1] * 5, list(range(100, 160))])
def test_radix_ranks_equal_a_sort(spark, ids):
    rng = random.Random(2)
    rows = [(i, rng.choice([-3, 0, 7, 2**40, -2**40])) for i in ids]
    got = R.ranked(spark.createDataFrame(rows, "doc_id long, score long"), chunk_rows=7, digit_bits=5).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[1], math.inf if r[0] is None else r[0]))
    assert [(r["doc_id"], r["score"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(rows) + 1))


def test_draw_on_awkward_rows(awkward, nothing):
    target = awkward.select("text")
    got = R.resampled(awkward, target)
    assert got.count() == 9 and got.filter("rank IS NOT NULL").count() == 0 and R.resampled(nothing, target).count() == 0
    assert R.resampled(awkward, nothing, R.Resampling(percent=100, least_words=5)).filter("rank IS NOT NULL").count() == 5
    assert R.drawn(awkward, got).columns == awkward.columns


# phrases

def slow_phrases(docs, rule):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= rule.least}
        gone = {q[i:i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= rule.percent * found[q[i:i + k]]}
        best = []
        for p, a in found.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(x for x in best if tuple(x[2].decode().split(" ")) not in gone)[:rule.most], 1)]
    return sorted(out)


@pytest.mark.parametrize("rule, aim", [(P.PhraseRule(3, 80, 10), 1), (P.PhraseRule(2, 60, 2000), 2), (P.PhraseRule(4, 80, 3), 1)])
def test_phrases_equal_plain_counting(spark, rule, aim):
    rng = random.Random(3)
    words = ["new", "york", "New", "the", "of", "city", "É", "straße", "a\x00b", "漢字", "x'y", "-"]
    weights = [6, 6, 2, 9, 9, 3, 2, 2, 1, 1, 1, 1]
    docs = []
    for i in range(400):
        text = "".join(rng.choice(["new york city", *rng.choices(words, weights, k=6)]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randint(0, 25)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([text, text, text, None, ""])))
    got = P.collocations(spark.createDataFrame([(*d, 0) for d in docs], "lang string, text string, rank int"), rule, first_aim=aim).collect()
    assert sorted(tuple(r) for r in got) == slow_phrases(docs, rule)


def test_levels_fall_until_enough_survive(spark, monkeypatch):
    """Pairs that longer phrases absorb leave too few at the first level."""
    rounds = []
    real = P.levels_of
    monkeypatch.setattr(P, "levels_of", lambda pairs, wanted: rounds.append(real(pairs, wanted)) or rounds[-1])
    docs = [("en", " ".join(f"q{i} r{i} s{i} t{i}" for i in range(12)) + ". " + ". ".join(f"u{i % 5} v{i % 7}" for i in range(30)))] * 5
    rule = P.PhraseRule(5, 80, 14)
    got = P.collocations(spark.createDataFrame(docs, "lang string, text string"), rule, first_aim=1).collect()
    assert len(rounds) > 1 and sorted(tuple(r) for r in got) == slow_phrases(docs, rule)


def test_filters_and_counts(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    inside, outside = (rng.integers(-2**62, 2**62, (500, 2)) for _ in range(2))
    rows = spark.createDataFrame([("en", *map(int, r)) for r in inside], "lang string, h1 long, h2 long")
    bits = P.BitFilter.of(rows, ["h1", "h2"], bits=16)
    assert bits.has("en", inside.view(np.uint64)).all() and bits.has("en", outside.view(np.uint64)).mean() < 0.05
    grams = rng.integers(1, 6, (5000, 4)) + 10**6
    found, n = P.distinct(grams)
    assert dict(zip(map(tuple, found.tolist()), n.tolist())) == collections.Counter(map(tuple, grams.tolist()))


def test_phrases_on_awkward_rows(awkward, nothing):
    assert P.collocations(nothing).count() == 0
    got = {(r["lang"], r["phrase"]): r for r in P.collocations(awkward, P.PhraseRule(2)).collect()}
    assert got["de", "zwei drei vier fünf"]["a"] == 3000 and not any(p.startswith("sechs") for _, p in got)


# personal data

KINDS = ["email", "ip", "card", "phone"]


def slow_luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def slow_spans(t):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and slow_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def pii(spark):
    return B.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), copies=16)


def digest(text):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in slow_spans(text or ""))


def test_base_spans_equal_plain_expressions(spark, pii):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "23", "0255", "256", "+", "-", " ", "(", ")", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4",
             "é", "😀", "a@b.c", "\n", "%", "0000", "x@y", "..", "12345678901234", "+49 30 1234567", "call (415) 555-2671", "a [at] b [dot] com"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))) for i in range(1500)] + [(-1, None), (-2, "a@b.cd " * 700 + "1.1.1.1 (555) 123-4567 " * 300)]
    rows = B.scanned(spark.createDataFrame(docs, "doc_id long, text string"), pii).select("doc_id", "text", *B.summary(F.col("pii"))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = digest(r["text"])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["text"]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [":".join(s) for s in spans if s[0] in KINDS] == [s for s in want.split(",") if s]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        # added spans meet neither base spans nor one another
        base = [(int(s[1]), int(s[2])) for s in spans if s[0] in KINDS]
        added = [(int(s[1]), int(s[2])) for s in spans if s[0] not in KINDS]
        assert not any(a < d and c < b for a, b in added for c, d in base) and all(a[1] <= b[0] for a, b in zip(added, added[1:]))


@pytest.mark.parametrize("text", ["a" * 200000, "1 " * 100000, "+1" * 100000, "a@b" + ".c" * 100000, "1.1." * 20000, "(" * 100000, ":" * 100000, "12-34-" * 30000])
def test_long_runs_end(spark, pii, text):
    r = B.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii).select(*B.summary(F.col("pii"))).first()
    assert r["base_sha256"] == hashlib.sha256(digest(text).encode()).hexdigest()


def test_trees_find_held_out_examples_and_leave_others(spark, pii):
    made = B.examples(["alpha beta gamma delta some plain words from another text"], copies=4, seed=123)
    rows = spark.createDataFrame([(n, *e) for n, e in enumerate(made)], "n long, text string, kind string, personal boolean")
    hit, wrong, n = collections.Counter(), 0, collections.Counter()
    for r in B.scanned(rows, pii).collect():
        n[r["kind"], r["personal"]] += 1
        hit[r["kind"]] += r["personal"] and any(s["kind"] == r["kind"] for s in r["pii"])
        wrong += not r["personal"] and any(s["kind"] not in KINDS for s in r["pii"])
    assert all(hit[k] >= 0.6 * n[k, True] for k in B.ADDED), hit
    assert sum(hit.values()) >= 0.8 * sum(v for (_, p), v in n.items() if p) and wrong <= 0.03 * sum(v for (_, p), v in n.items() if not p)


def test_columns_score_like_plain_trees(spark, pii):
    rows = B.candidates(spark.createDataFrame([(t,) for t, *_ in B.examples([], copies=1)], "text string"), "text").select(F.explode("candidates.x").alias("x"))
    for r in rows.withColumn("score", pii.score(F.col("x"))).collect():
        assert r["score"] == pytest.approx(pii.plain_score(r["x"]))


def test_personal_data_on_awkward_rows(spark, awkward, nothing, pii, tmp_path):
    found = B.scanned(awkward, pii)
    assert found.columns == [*awkward.columns, "pii"] and found.count() == 9 and B.scanned(nothing, pii).count() == 0
    docs = spark.createDataFrame([(1, "call (415) 555-2671 or a@b.co, +1 (555) 123-4567."), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in B.redacted(docs, pii).collect()}
    assert clean == {1: "call [PHONE_LOCAL] or [EMAIL], [PHONE].", 2: None, 3: "", 4: "nothing"}
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    assert Q.op12_pii_boosting(spark, str(tmp_path)).columns == ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

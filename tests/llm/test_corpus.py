"""Operators that look at many rows: neighbours, shards, Jaccard join, packing, licences, and the pipeline."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import components, histogram_packing, jaccard_groups, label_shards, license_classifier, multi_index
from barloom.llm import queries as Q

DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# inverted multi-index

def brute_nearest(ids, vectors, q, near=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    like = unit @ unit[q]
    order = [i for i in np.lexsort((ids, -np.round(like, 14))) if ids[i] != ids[q]]
    return [(int(ids[i]), float(like[i])) for i in order[:near]]


def test_walk_opens_cells_in_order_of_their_sum():
    rng = np.random.default_rng(1)
    one, two, counts = rng.random(6), rng.random(5), rng.integers(0, 4, (6, 5))
    sums = sorted((one[i] + two[j], i, j) for i in range(6) for j in range(5) if counts[i, j])
    assert multi_index.walk(one, two, counts, 10**9) == [(i, j) for _, i, j in sums]
    some = multi_index.walk(one, two, counts, 7)
    assert sum(counts[c] for c in some) >= 7 > sum(counts[c] for c in some[:-1])


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    vectors = np.concatenate([centres[rng.integers(0, 30, 2900)] + 0.3 * rng.normal(size=(2900, 16)), np.repeat(centres[:1], 100, axis=0)])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in multi_index.nearest(rows, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, hits = np.arange(len(vectors)), 0
    for q in range(0, len(vectors), 50):
        want = brute_nearest(ids, vectors, q)
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert len(got[q]) == 5
    assert hits / (5 * len(got)) > 0.9
    # of 100 equal vectors the smallest ids are nearest
    assert [i for i, _ in got[2950]] == [2900, 2901, 2902, 2903, 2904] and [i for i, _ in got[2900]] == [2901, 2902, 2903, 2904, 2905]


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, []), (7, [1.0]), (0, [1.0, 0.0])]
    got = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got] == [(0, 1, 7, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 7, 0.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.nearest(none, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("asked", [4000, 3])
def test_ties_between_scaled_copies_go_to_the_smaller_id(spark, monkeypatch, asked):
    monkeypatch.setattr(multi_index, "ASKED", asked)
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    rows = [(i, [float(x) for x in v * (1 + i % 17) * 3.7**(i % 5)]) for i in range(60)] + [(100 + i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    got = defaultdict(list)
    for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and all(len(g) == 5 for g in got.values()) and len(got) == 10


# balanced label propagation

def test_shards_are_even_and_keep_links(spark):
    rows = Q.op3_label_propagation(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(held) == list(range(8)) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    lines = defaultdict(list)
    for r in rows:
        for line in {x for x in texts[r["doc_id"]].split("\n") if len(x) >= label_shards.LINE_CHARS}:
            lines[line].append(r["shard"])
    pairs = [(n * (n - 1), sum(c * (c - 1) for c in Counter(v).values())) for v in lines.values() if (n := len(v)) > 1]
    assert sum(s for _, s in pairs) > 0.4 * sum(n for n, _ in pairs)  # 0.125 by chance


def test_shards_of_awkward_rows(awkward, nothing):
    rows = label_shards.sharded(awkward, rounds=1).collect()
    assert len(rows) == 9 and max(Counter(r["shard"] for r in rows).values()) == 2 and all(r["slot"] is not None for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1} and label_shards.sharded(nothing).count() == 0
    one_text = awkward.select("doc_id", F.lit("same text of more than forty characters, a third of all").alias("text"))
    assert max(Counter(r["shard"] for r in label_shards.sharded(one_text).collect()).values()) == 2


def test_pure_copies_stay_in_one_shard(spark):
    texts = {f"copied page {n}, whose only line of forty characters nobody else has": 300 - 20 * n for n in range(5)}
    texts["one page that fills more than a shard and needs two, no more than two"] = 700
    rows = [t for t, n in texts.items() for _ in range(n)] + [f"single page {n}" for n in range(2000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = label_shards.sharded(docs).collect()
    loads = Counter(r["shard"] for r in got)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    held = {t: len({r["shard"] for r in got if rows[r["doc_id"]] == t}) for t in texts}
    assert sorted(held.values()) == [1, 1, 1, 1, 1, 2]


def test_quotas_take_the_largest_gains_first():
    flow = [{"shard": 0, "to": 1, "power": 5, "rows": 10}, {"shard": 0, "to": 1, "power": 2, "rows": 10}]
    assert label_shards.quotas(flow, [50, 35], 50) == {(1, 5): 1.0, (1, 2): 0.5}


# n-gram Jaccard join

def word_sets(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*[w[i:] for i in range(words)])) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute_components(ids, texts, words, percent):
    sets, up = word_sets(texts, words), list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for n, i in enumerate(ids):
        least[root(n)].append(i)
    return [(i, len(sets[n]), min((x for x in least[root(n)] if x is not None), default=None)) for n, i in enumerate(ids)]


def near_texts(rng, n=220):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            t = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30]))]
        texts.append((" " if rng.random() < 0.5 else "\n").join(t).upper() if rng.random() < 0.3 else " ".join(t))
    return texts


@pytest.mark.parametrize("words,percent,block", [(3, 90, 1500), (5, 80, 1500), (3, 90, 20)])
def test_components_equal_all_pairs(spark, words, percent, block):
    texts = near_texts(random.Random(words + block))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_groups.joined(docs, jaccard_groups.JaccardRule(words, percent), block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(range(len(texts)), texts, words, percent))


def test_matrix_opens_all_groups_with_links():
    rng = random.Random(9)
    rule = jaccard_groups.JaccardRule(3, 80)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randint(1, 30))] + list(range(100, 100 + rng.choice([0, 25]))), dtype=np.uint64)) for _ in range(90)]
    for side in (np.zeros(90, int), np.array([i % 2 for i in range(90)])):
        joined = jaccard_groups.Forest(90)
        for a, b in jaccard_groups.linked(sets, side, rule, group=4):
            joined.join(a, b)
        plain = jaccard_groups.Forest(90)
        for a in range(90):
            for b in range(a):
                same = len(np.intersect1d(sets[a], sets[b]))
                if (not side.any() or side[a] != side[b]) and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    plain.join(a, b)
        assert [joined.root(i) for i in range(90)] == [plain.root(i) for i in range(90)]


@pytest.mark.parametrize("percent", [40, 80, 90, 100])
def test_sketches_lose_no_link(percent):
    rng = random.Random(percent)
    rule = jaccard_groups.JaccardRule(3, percent)
    sets = []
    for size in (2, 9, 300, 900, 6000):
        base = [rng.getrandbits(64) for _ in range(size)]
        sets += [np.unique(np.array(base[:rng.randint(size * percent // 110, size)] + [rng.getrandbits(64) for _ in range(rng.choice([0, 1, size // 12]))] + base[:1], dtype=np.uint64)) for _ in range(12)]
    order = sorted(range(len(sets)), key=lambda i: (i % 2, len(sets[i])))
    found = jaccard_groups.alike(np.array([i % 2 for i in order]), np.array([len(sets[i]) for i in order]), [jaccard_groups.sketch(sets[i], rule.bits(len(sets[i]))) for i in order], rule)
    joined = jaccard_groups.Forest(len(sets))
    assert all([joined.join(order[a], order[b]) for a, b in found])
    for a, b in itertools.combinations(range(len(sets)), 2):
        same = len(np.intersect1d(sets[a], sets[b]))
        if a % 2 == b % 2 and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            assert joined.root(a) == joined.root(b)
        assert a % 2 == b % 2 or joined.root(a) != joined.root(b)


@pytest.mark.parametrize("holders", [7, 20_000])
def test_sets_that_share_rare_shingles_by_chance_are_not_sent(spark, monkeypatch, holders):
    """A chain of texts, each with a phrase of the one before, was one candidate group of which each pair of blocks got all sets."""
    rng = random.Random(31)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(120)]
    texts = [" ".join([*t[:40], *texts[i - 1][40:46], *t[40:]]) for i, t in enumerate(texts)]
    texts += [t + " other" for t in texts[:5]]
    sent, real, rejoin = [], jaccard_groups.in_blocks, jaccard_groups.pairings
    monkeypatch.setattr(jaccard_groups, "in_blocks", lambda members, block: sent.append(real(members, block).count()) or real(members, block))
    if holders < 20_000:
        monkeypatch.setattr(jaccard_groups, "pairings", lambda near, rule: rejoin(near, rule, holders))
    got = jaccard_groups.joined(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), block=10).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(range(len(texts)), texts, 3, 90))
    assert len({r["component_id"] for r in got}) < len(texts) and sent == [2 * sum(r["component_id"] != r["doc_id"] for r in got)]


def test_jaccard_of_awkward_rows(spark, awkward, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups.joined(awkward).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4][1] == 0 and got[0][1] == 0
    assert jaccard_groups.joined(awkward).count() == 9 and jaccard_groups.joined(nothing).count() == 0
    left = jaccard_groups.one_of_each(awkward)
    assert left.columns == awkward.columns and sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 7]


def test_links_go_through_rows_without_an_id(spark):
    rng = random.Random(12)
    a = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    b, c = [*a[:-2], "x", "y"], [*a[2:-2], "x", "y", "z", "u"]
    far = [f"v{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(10, a), (None, b), (20, c), *[(None, far)] * 40, (None, [*far[:-1], "q"]), (7, [*far[1:], "r"]), (None, ["alone"] * 3), (None, None)]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in rows], "doc_id long, text string")
    rule = jaccard_groups.JaccardRule(3, 90)
    got = jaccard_groups.joined(docs, rule).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["n_shingles"] == 78 and r["doc_id"] in (10, 20)} == {10}
    assert sorted(str(r["component_id"]) for r in got) == sorted(["10"] * 3 + ["7"] * 42 + ["None"] * 2)
    left = jaccard_groups.one_of_each(docs, rule)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["10", "7", "None", "None"])


def test_one_row_of_each_component_stays_and_clean_rows_do(spark):
    rng = random.Random(13)
    t = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    text, near, clean = " ".join(t), " ".join([*t[:-1], "other"]), " ".join(f"c{n}" for n in range(50))
    rows = [(1, text), (1, text), (2, near), (2, clean), (None, text), (None, text), (3, clean + " end"), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, {"a": 1}) for r in rows], "doc_id long, text string, extra map<string,int>")
    left = jaccard_groups.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, text), (2, clean), (3, ""), (3, "")], key=str)


@pytest.mark.parametrize("few", [0, 500_000])
def test_joins_of_many_candidates_equal_those_of_few(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_groups, "BROADCAST_ROWS", few)
    texts = near_texts(random.Random(50))
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:30])], "doc_id long, text string")
    got = {tuple(r) for r in jaccard_groups.joined(docs, jaccard_groups.JaccardRule(3, 90), block=25).collect()}
    assert got == set(brute_components(range(len(texts)), texts, 3, 90))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 300), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == got[200] == 200 and 300 not in got


# best-fit packing

def test_plan_places_all_and_wastes_little():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 50, 128])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 20))}
        used, placed = defaultdict(list), Counter()
        for s in histogram_packing.plan(counts, capacity):
            for r in range(s.to_rank - s.from_rank):
                used[s.sequence + r // s.each].append((s.offset + r % s.each * s.length, s.length))
                placed[s.length] += 1
        assert placed == Counter(counts)
        for v in used.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) <= 11 / 9 * max(1, -(-sum(n * c for n, c in counts.items()) // capacity)) + max(1, sum(c for n, c in counts.items() if 2 * n > capacity))


@pytest.mark.parametrize("added", [True, False])
def test_ids_equal_those_of_the_tokenizer(added):
    rng = random.Random(7)
    plain = Tokenizer.from_file(VOCABULARY)
    if not added:
        plain.encode_special_tokens = True
    own = histogram_packing.Encoder(VOCABULARY, added)
    parts = [" ", "  ", "\n", "\t", "a", "Hello", "'s", "é", "1", "12", "!", "\xa0", "　", "\r\n", "<|endoftext|>", "漢", "ß", "x'll", "\x1c", "​", "\x85", " word", "\0", "\0The", "The", "<|endof", "text|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["The", "a \0The", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>a"]
    for t, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == want.ids, repr(t)


def test_packing_gives_back_every_document(spark, awkward, nothing):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(awkward.filter("doc_id IN (1, 2, 5)").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    rows = histogram_packing.packed(docs, VOCABULARY).collect()
    plain = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        got = sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
        ids = np.concatenate([np.frombuffer(x["ids"], "<u4") for x in got]).tolist()
        assert ids == plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert [x["start"] for x in got] == np.cumsum([0, *[x["length"] for x in got]])[:-1].tolist() and all(x["length"] == 2048 for x in got[1:])
    for v in by_sequence.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *[n for _, n in sorted(v)]])[:-1].tolist() and sum(n for _, n in v) <= 2048
    assert histogram_packing.packed(nothing, VOCABULARY).count() == 0


# licences

def test_licences_held_out():
    rng = random.Random(8)
    plain = [" ".join(rng.choice(["the", "of", "work", "public", "river", "stone", "free", "light", "under", "source"]) for _ in range(12)) for _ in range(300)]
    model = license_classifier.fit(plain)

    def judge(text):
        z = np.array([model.bias[i] + sum(w[i] for g in license_classifier.ngrams(text) if (w := model.weights.get(g)) is not None) for i in range(len(model.families))]) / model.temperature
        p = license_classifier.softmax(np.append(z, 0.0)[None, :])[0]
        return (*model.families, "unknown")[int(p.argmax())]

    seen = {"Licensed under the Apache License, Version 2.0": "apache", "Code released under the MIT License by us": "mit", "licensed under CC BY-NC 4.0 by the author": "cc-by-nc",
            "available under CC BY-SA 4.0": "cc-by-sa", "the GNU General Public License, version 3 applies": "gpl", "All rights reserved.": "proprietary", "the river under the stone": "unknown",
            "a public work of free light": "unknown"}
    assert {t: judge(t) for t in seen} == seen


def test_licences_of_rows(spark, awkward, nothing):
    docs = spark.createDataFrame([(1, "Prose of the day.\nLicensed under the Apache License, Version 2.0.\nMore prose"), (2, "All rights reserved."), (2, "All rights reserved."), (3, None), (4, "no notice")], "doc_id long, text string")
    rows = license_classifier.scanned(docs, license_classifier.trained(docs)).filter("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in rows) == [(1, 1, "apache"), (2, 0, "proprietary"), (2, 0, "proprietary")]
    assert license_classifier.scanned(awkward, license_classifier.trained(awkward)).filter("confirmed").count() == 0
    assert license_classifier.scanned(nothing, license_classifier.trained(nothing)).count() == 0


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:""",
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "apache": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""}


def test_wrapped_notices_are_one_paragraph(spark):
    docs = spark.createDataFrame([(n, f"Copyright 2020 Someone\n\n  \n{t}\n\nint main() {{ the river under }}\n") for n, t in enumerate(WRAPPED.values())], "doc_id long, text string")
    rows = license_classifier.scanned(docs, license_classifier.trained(spark.read.parquet(f"{DIR}/documents.parquet"))).filter("confirmed").collect()
    assert {(r["doc_id"], r["family"], r["first_line"], r["last_line"]) for r in rows} == {(n, f, 3, 3 + t.count("\n")) for n, (f, t) in enumerate(WRAPPED.items())}


def plain_paragraphs(text):
    """(first line, last line, lines) by a walk over the lines."""
    out, run = [], []
    for n, line in enumerate([*text.split("\n"), ""]):
        if line.strip(" \t\r\f\x0b"):
            run.append((n, line))
        if run and (not line.strip(" \t\r\f\x0b") or line.rstrip(" \t\r\f\x0b")[-1] in ".!?"):
            out.append((run[0][0], run[-1][0], "\n".join(x for _, x in run)))
            run = []
    return out


def test_paragraphs_equal_a_walk_over_lines(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice(["a b", ".", "!", " ", "\t", "\n", "\n", "\n\n", "é", "x.", "\r\n"]) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["w\n" * 20000, "x " * 50000]
    got = defaultdict(list)
    for r in license_classifier.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").orderBy("doc_id", "paragraph").collect():
        got[r["doc_id"]].append((r["first_line"], r["last_line"], r["line"].rstrip(" \t\r\n")))
    for n, t in enumerate(texts):
        assert got[n] == [(a, b, p.rstrip(" \t\r\n")) for a, b, p in plain_paragraphs(t)], repr(t[:200])


def test_scoring_of_a_table_equals_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_classifier.trained(docs)
    got = {(r["doc_id"], r["paragraph"]): r for r in license_classifier.scanned(docs, model).collect()}
    cues, seen = set(model.cues()), set()
    for r in docs.collect():
        for n, (_, _, p) in enumerate(plain_paragraphs(r["text"])):
            if cues.intersection(license_classifier.words(p)):
                seen.add((r["doc_id"], n))
                all_grams = {*license_classifier.words(p), *license_classifier.pairs(p)}
                hits = [model.weights[g] for g in all_grams if g in model.weights]
                row = got[r["doc_id"], n]
                z = (model.bias + sum(hits)) / model.temperature if hits else None
                chance = license_classifier.softmax(np.append(z, 0.0)[None, :])[0] if hits else np.zeros(1)
                assert row["probability"] == pytest.approx(chance[:-1].max() if hits else 0.0, abs=1e-9)
                assert row["family"] == (model.families[int(chance[:-1].argmax())] if hits and chance[:-1].max() >= 0.5 else "unknown")
    assert seen == set(got)


# pipeline

def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.settle(stage(spark, docs, DIR), "test")
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert left <= ids and (left < ids) == (name != "secret scans")
        ids, docs = left, after
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DIR).collect()} == ids

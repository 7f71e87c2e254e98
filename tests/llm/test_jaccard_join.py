import random
import re

import pytest

from tallyweave.llm import jaccard_join
from tallyweave.llm.jaccard_join import jaccard_components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, n, num, den):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    leader = {i: i for i in ids}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                leader[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def corpus(seed, groups=6, size=14, words=60):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, words, 3 * words]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
            rows.append((k, " ".join(text)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "One"), (k + 4, "one"), (k + 5, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "rounds"), [(3, 90, 2), (5, 80, 2), (3, 90, 0)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, rounds):
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", max(1, rounds))
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 5)
    monkeypatch.setattr(jaccard_join, "BUCKET_NODES", 3)
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, n=n, similarity=(num, 100)).collect()}
    assert got == brute(rows, n, num, 100)


def test_edges(spark):
    rows = [(1, "a b c d e", 5), (1, "a b c d e", 5), (None, "a b c d e", 6), (None, "q r s t u", 6), (9, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, n=3).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 3, None), (9, 0, 9)], key=str)
    assert jaccard_components(docs.limit(0), n=3).count() == 0


def test_bands_cover_partners():
    for similarity in ((90, 100), (80, 100), (50, 100)):
        num, den = similarity
        ends = jaccard_join.bands(5000, similarity)
        for n in range(1, 3000):
            own = max(i for i, e in enumerate(ends) if e <= n)
            assert n * den // num < ends[own + 2]


def test_copies_are_left_out_once(spark, monkeypatch):
    written, materialize = {}, jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: written.setdefault(label, []).append(df.select("id").count() if label == "nodes" else 0) or materialize(df, label))
    rows = [(k, " ".join(f"w{j}x{max(k, 4)}" for j in range(60))) for k in range(9)] + [(9, None)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n=3, similarity=(90, 100)).collect()}
    assert got == {k: 0 if k < 5 else k for k in range(10)}
    assert written["nodes"] == [5]

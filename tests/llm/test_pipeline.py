"""The pipeline against a plain version of its stages."""

import hashlib
import random
import re

import corpus_pipeline
from tallyweave.llm import bpe, queries

from test_jaccard_join import LOWER, brute


def plain(rows, items, toxic):
    rows = [(i, t) for i, t in rows if i not in toxic]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    lost = lambda i, line: len(key(line)) >= 10 and len(holders[key(line)]) > 1 and i != min(holders[key(line)])
    rows = [(i, "\n".join(x for x in (t or "").split("\n") if not lost(i, x))) for i, t in rows]
    groups = brute(rows, 5, 80, 100)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 13]) for w in map(words, items) for k in range(max(1, len(w) - 12)) if w}
    kept = []
    for i, t in rows:
        w = words(t)
        hit = {p for k in range(len(w)) for n in {len(x) for x in windows} if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append((i, t))
    return kept


def test_pipeline_equals_plain_version(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"n{rng.choice('abcdefgh')}{rng.choice('klmnop')}x"
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, text(20) + (" nastyword" if k % 3 == 0 else "")) for k in range(300)]
    items = [text(15), text(30), None]
    shared = "One line that many documents share"
    rows += [(400, rows[1][1]), (401, rows[1][1] + " more"), (402, items[0] + " " + text(9)), (403, text(300) + " " + items[1][: items[1].rindex(" ", 0, 75)]), (404, None), (405, "")]
    rows += [(410 + k, f"{text(12)}\n {shared.upper() if k else shared}\n{text(12)}") for k in range(6)]
    rows += [(420, text(800) + " " + " ".join(items[1].split()[:13]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    want = dict(plain(rows, items, {k for k in range(0, 300, 3)}))
    assert set(got) == set(want)
    assert 402 not in got and 401 not in got and {400, 403, 404, 405, 420, *range(410, 416)} <= set(got)
    encoding = bpe.load(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.bpe_pattern())
    for i, t in want.items():
        ids = encoding.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()

"""Clashing names, very long texts, repeated rows and empty tables, and comparisons with plain versions."""

import hashlib

import pytest

from tallyweave.llm import bpe, line_dedup, queries, runtime, token_store, toxicity


def test_line_dedup_with_clashing_names(spark):
    names = "doc_id bigint, text string, gone string, oid string, rid string, RowS string, parts string, edges int, h1 int, __kept string, owner int"
    docs = spark.createDataFrame([(k, "the same line of text\nown %d" % k, "a", "b", "c", "d", "e", 1, 2, "x", 3) for k in (1, 2)], names)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "__kept"] + ["__n_lines", "__n_dropped", "__kept"]
    assert [(r["doc_id"], r["gone"], r["oid"], r["__n_dropped"], r["__kept"]) for r in out.orderBy("doc_id").collect()] == [(1, "a", "b", 0, "the same line of text\nown 1"), (2, "a", "b", 1, "own 2")]


def test_later_batches_read_compacted_runs(spark):
    runs = line_dedup.LineRuns(spark)
    for k in range(5):
        found = line_dedup.drop_repeated_lines(spark.createDataFrame([(k, f"a line of all batches\nline of batch {k}\nline of two batches {k // 2}")], "doc_id bigint, text string"), batches=1, runs=runs)
        assert found.first()["__n_dropped"] == (k > 0) + k % 2
    assert [len(level) for level in runs.levels] == [1, 0, 1]


def test_last_batch_writes_no_run(spark):
    docs = spark.createDataFrame([(k, f"a line of all documents\nown line number {k}\nline of pairs {k // 2}") for k in range(40)], "doc_id bigint, text string")
    with runtime.owned(spark, "last batch"):
        found = line_dedup.drop_repeated_lines(docs, batches=4)
    written = [path.rsplit("-", 1)[1] for owner, path in spark.sparkContext._tallyweave_tables if owner == "last batch"]
    assert {r["doc_id"]: r["__n_dropped"] for r in found.collect()} == {k: (k > 0) + k % 2 for k in range(40)}
    runtime.release(spark, "last batch")
    assert written == ["lines", "run", "run", "run", "run"]  # three batches and the merged run of two


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "word " * 20_000 + " " * 1_000_000 + "end of it", "a.\n" * 60_000 + "\t" * 20_000, "é " * 40_000 + " " * 30_000 + "!", "x" + "\n" * 10_001 + "\n'll"])
def test_bpe_long_white_space(text):
    encoding = bpe.load(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.bpe_pattern())
    ids = bpe.encode(encoding, text)
    assert bpe.decode(encoding, ids) == text.encode()
    if len(text) < 200_000:
        assert ids == encoding.encode_ordinary(text)


def test_bpe_pieces_at_every_kind_of_boundary():
    encoding = bpe.load(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.bpe_pattern())
    text = "Say: 'it's 12 o'clock', she'll go.\n\n \t x\x1cy\x1c z  漢字 42 ... !\r\n" * 400
    assert [i for piece in bpe.pieces(text, 50) for i in encoding.encode_ordinary(piece)] == encoding.encode_ordinary(text)


def test_bpe_table_edges(spark):
    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.bpe_pattern()
    docs = spark.createDataFrame([(1, "same", "n"), (1, "same", "n"), (None, None, "n")], "doc_id bigint, text string, n_tokens string")
    got = bpe.round_trip(docs, path, pattern).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (1, 2), (1, 2)]
    assert bpe.round_trip(docs.limit(0), path, pattern).count() == 0


def test_token_store_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "b", 1), (2, "a", 1), (2, "a", 1), (None, None, 1)], "doc_id bigint, text string, start int")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.store_and_read(docs, queries.tokenizer_path("byte_bpe_50k.json")).collect())
    assert [x[1:] for x in got] == [(None, 1), (None, 2), (2, 2), (2, 2)] and [x[0] for x in got] == [0, 1, 3, 5]


def test_toxicity_edges(spark):
    rows = [(k, ("vile rotten words " if k % 2 else "kind plain words ") + f"w{k}", 1.0) for k in range(40)]
    docs = spark.createDataFrame(rows + [(50, "vile " * 300_000, 1.0), (1, rows[1][1], 1.0), (None, None, 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "score"] and out.count() == 43
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert got[50] >= 0.5 and all((got[k] >= 0.5) == bool(k % 2) for k in range(40))
    assert toxicity.reject(docs, model).columns == docs.columns


def test_counterfactual_term_lowers_false_positives_on_neutral_mentions(spark):
    """Half of the toxic texts mention a group, so a plain model learns the mention; held-out neutral mentions show it."""
    texts, labels = [], []
    for k in range(400):
        digest = hashlib.md5(str(k).encode()).hexdigest()
        filler = " ".join(f"n{digest[i : i + 2]}" for i in range(0, 16, 2))
        bad = k % 2 == 0
        texts.append((k, filler + (" muslim" if bad and k % 8 else "") + (f" {hashlib.md5(b'slur%d' % (k // 2 % 40)).hexdigest()[:7]}" if bad else "")))
        labels.append((k, int(bad)))
    neutral = [(1000 + k, f"my {term} neighbour reads n{k:02x} and nab") for k, term in enumerate(["muslim", "christian", "jewish", "hindu", "buddhist"] * 4)]
    docs, lab = spark.createDataFrame(texts + neutral, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    wrong = []
    for weight in (0.0, 20.0):
        model = toxicity.train(docs, lab, counterfactual=weight)
        wrong.append(toxicity.score(docs.where("doc_id >= 1000"), model).where("score >= 0.5").count())
    assert wrong[0] >= 4 and wrong[1] == 0


def test_release_is_by_owner(spark):
    with runtime.owned(spark, "one"):
        one = runtime.materialize(spark.range(3), "x")
    with runtime.owned(spark, "two"):
        two = runtime.materialize(spark.range(4), "x")
    free = runtime.materialize(spark.range(5), "x")
    runtime.release(spark, "one")
    assert two.count() == 4 and free.count() == 5
    with pytest.raises(Exception):
        one.count()

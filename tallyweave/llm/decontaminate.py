"""Benchmark decontamination as a prefix-filtered containment join.

The tokens of a window (13 consecutive item words, or a whole shorter item) are ordered by rarity over
all documents. A document that contains the window contains its rarest token, so this one is the
necessary prefix: only places of prefix tokens in documents are joined. The token's place in the window
(positional bound) and the window's length fix where the window would lie; what would leave the document is cut, the
others meet the benchmark's windows by a fingerprint of all their words (128 bits with the token's), which verifies containment.

Benchmark and documents are tables on both sides of every join. To tasks go only two bitmaps of fixed
size (words of the benchmark, prefix tokens and windows), which spare rows and never decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .runtime import column_buffers, list_array, materialize, prepare, small_side

WINDOW = 13
#: Bits of each bitmap (512 KB), whatever the benchmark's size; a full one only lets more rows through.
BITS = 1 << 22
_U = np.uint64
_CANDS = "array<struct<start:int,size:int,token:bigint,print:bigint>>"


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits of the distinct 64-bit values: set by an aggregation over at most BITS / 64 groups."""
    place = F.pmod(F.col(column), F.lit(BITS))
    rows = values.select(F.floor(place / 64).cast("int").alias("at"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _held(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    return bitmap[(values & _U(len(bitmap) - 1)).astype(np.int64)]


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint of each run of `size` words, by place of its first."""
    return W.mix(W.shingles(hashes, size) ^ _U(W.mix_int(size)))


def _words_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, text): (name, words), the distinct words of each text."""
    for batch in batches:
        data, bounds = column_buffers(batch.column(1))
        lists = []
        for chunk in W.words(data, bounds, W.ALNUM):
            cut = chunk.bounds()
            lists += [np.unique(chunk.hash[cut[r] : cut[r + 1]]).view(np.int64) for r in range(chunk.rows)]
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, np.array([len(x) for x in lists], np.int64), pa.int64())], names=["name", "words"])


def _count_kernel(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_buffers(batch.column(0))
            found = [x[_held(bitmap, x)] for x in (chunk.hash for chunk in W.words(data, bounds, W.ALNUM))]
            names, n = np.unique(np.concatenate(found) if found else np.zeros(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return run


def _windows_kernel(window: int):
    """Rows (name, text, words, counts): (name, token, offset, size, print) of the item's windows, token the rarest (ties: smallest hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_buffers(batch.column(1))
            flat = [batch.column(k).flatten().to_numpy() for k in (2, 3)]
            cut = (batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()).tolist() if batch.num_rows else [0]
            ids, columns = [], [[], [], [], []]
            for chunk in W.words(data, bounds, W.ALNUM):
                reach = chunk.bounds()
                for r in range(chunk.rows):
                    own = chunk.hash[reach[r] : reach[r + 1]]
                    size = min(window, len(own))
                    if not size:
                        continue
                    k = chunk.first + r
                    names, counts = (x[cut[k] : cut[k + 1]] for x in flat)
                    order = np.argsort(names.view(_U))
                    rarity = np.empty(len(names), np.int64)
                    rarity[np.lexsort((names[order].view(_U), counts[order]))] = np.arange(len(names))
                    ranks = rarity[np.searchsorted(names[order].view(_U), own)]
                    offset = np.lib.stride_tricks.sliding_window_view(ranks, size).argmin(axis=1)
                    n = len(offset)
                    ids.append(np.full(n, k))
                    for column, x in zip(columns, (own[np.arange(n) + offset].view(np.int64), offset, np.full(n, size), window_prints(own, size).view(np.int64)), strict=True):
                        column.append(x)
            place = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            token, offset, size, prints = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(token), pa.array(offset.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(prints)], names=["name", "token", "offset", "size", "print"])

    return run


def _probe_kernel(tokens: np.ndarray, prints: np.ndarray, shapes: list[tuple[int, int]]):
    """Rows (id, h1, h2, text): (id, h1, h2, n_words, cands); shapes are the (size, offset) of prefix tokens that windows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = column_buffers(batch.column(3))
            n_words, counts, columns = [], [], [[], [], [], []]
            for chunk in W.words(data, bounds, W.ALNUM):
                n = len(chunk.hash)
                reach = chunk.bounds()
                n_words.append(np.diff(reach))
                place = np.flatnonzero(_held(tokens, chunk.hash))
                row, start, size, token, seen = ([np.zeros(0, np.int64)] for _ in range(5))
                for length in sorted({s for s, _ in shapes}) if len(place) else []:
                    if n < length:
                        continue
                    whole = window_prints(chunk.hash, length)
                    for offset in (o for s, o in shapes if s == length):
                        at = place - offset
                        own = chunk.row[place]
                        fits = (at >= reach[own]) & (at + length <= reach[own + 1])
                        at, own, held = at[fits], own[fits], place[fits]
                        some = _held(prints, whole[at])
                        row.append(own[some])
                        start.append(at[some] - reach[own[some]])
                        size.append(np.full(int(some.sum()), length))
                        token.append(chunk.hash[held[some]].view(np.int64))
                        seen.append(whole[at[some]].view(np.int64))
                row = np.concatenate(row)
                order = np.argsort(row, kind="stable")
                counts.append(np.bincount(row, minlength=chunk.rows))
                for column, x in zip(columns, (start, size, token, seen), strict=True):
                    column.append(np.concatenate(x)[order])
            start, size, token, seen = (np.concatenate(x) for x in columns)
            ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(token), pa.array(seen)], names=["start", "size", "token", "print"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.concatenate(n_words), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "h1", "h2", "n_words", "cands"])

    return run


def _text_key(text: Column) -> list[Column]:
    """128 bits that name a text; rows with equal texts have equal results."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(91), F.lit("text"), F.reverse(text)).alias("h2")]


def _judge(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(id, h1, h2, n_words) of every row, and (h1, h2, n_hit, items) of each text in which windows occur."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("text")).where("text is not null and name is not null")
    items = items.withColumn("part", F.xxhash64("name", "text"))
    texts = docs.select(F.col(text_col).alias("text"))
    # The rarity table: counts over all documents of the benchmark's words, one scan, summed by word.
    held = materialize(items.select("part", "text").mapInArrow(_words_kernel, "name bigint, words array<bigint>").select(F.col("name").alias("part"), F.explode("words").alias("word")).distinct(), "item_words")
    vocabulary = held.select("word").distinct()
    counted = texts.mapInArrow(_count_kernel(_bitmap(vocabulary, "word")), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.join(vocabulary, "word", "left_semi")
    rarity = held.join(counted, "word", "left").groupBy("part").agg(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n"))).alias("w"))
    listed = items.join(rarity, "part").select("name", "text", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))
    windows = materialize(listed.mapInArrow(_windows_kernel(window), "name string, token bigint, offset int, size int, print bigint"), "item_windows")
    shapes = sorted((r["size"], r["offset"]) for r in windows.select("size", "offset").distinct().collect())  # at most window * (window + 1) / 2
    probe = _probe_kernel(_bitmap(windows.select("token").distinct(), "token"), _bitmap(windows.select("print").distinct(), "print"), shapes)
    source = docs.select(F.col(id_col).alias("id"), *_text_key(F.col(text_col)), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("cands", T._parse_datatype_string(_CANDS))])
    rows = materialize(source.mapInArrow(probe, schema), "probed")
    # Equal texts are judged once. The join of prefix tokens, with the windows' fingerprints; a common window is one row there.
    cands = rows.where("size(cands) > 0").groupBy("h1", "h2").agg(F.first("cands").alias("cands")).select("h1", "h2", F.inline("cands"))
    kinds = windows.select("token", "offset", "size", "print").distinct()
    found = materialize(cands.join(small_side(kinds.drop("offset").distinct()), ["token", "size", "print"], "left_semi"), "occurrences")
    spans = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("s"))
    merged = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach")))
    hit = spans.select("h1", "h2", merged["n"].cast("bigint").alias("n_hit"))
    named = found.select("h1", "h2", "token", "print").distinct().join(windows.select("token", "print", "name").distinct(), ["token", "print"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_set("name")).alias("items"))
    return rows.drop("cands"), materialize(hit.join(named, ["h1", "h2"]), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, items (sorted names), contaminated.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII. A window is
    `window` consecutive words of an item; an item of fewer words, but not none, is one window. A word of a
    document inside any occurrence of a window is hit; a document with n_hit > 0 and
    n_hit / n_words >= share is contaminated. Null texts have no words and are clean; items that are null or
    without words match nothing; equal items each count, an item id that repeats counts once. Repeated rows are judged
    each; an empty table on either side gives no hits. Other columns aren't read, so their names don't matter.
    """
    rows, hits = _judge(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    num, den = share
    joined = rows.join(small_side(hits), ["h1", "h2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), items.alias("items"),
        ((n_hit > 0) & (n_hit * den >= F.col("n_words") * num)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """The rows of docs, all columns kept, that contamination() doesn't mark."""
    rows, hits = _judge(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    num, den = share
    lengths = rows.groupBy("h1", "h2").agg(F.first("n_words").alias("n_words"))
    bad = lengths.join(small_side(hits), ["h1", "h2"]).where(F.col("n_hit") * den >= F.col("n_words") * num).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    bad = materialize(bad, "contaminated")
    h1, h2 = (c for c in _text_key(docs[text_col]))
    return docs.join(small_side(bad), (h1 == bad["__h1"]) & (h2 == bad["__h2"]), "left_anti")

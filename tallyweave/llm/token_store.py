"""Token-id files: each document compressed on its own with a shared zstandard dictionary.

A file is one shard of documents in ascending id order:

    magic "TWTOK1\\0\\0" | u32 length of the JSON header | header | index | frames

The header holds the dictionary's SHA-256, the bytes of an id and the number of documents; the index has
for each document its id, the ids before it in the partition, its ids, and its frame's place and length,
so one short document is read without touching the others. Shards are rows of a Parquet table
(Spark's writers reach every store), the dictionary is a row of a second one.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import prepare, scratch_dir

MAGIC = b"TWTOK1\0\0"
#: Bytes of frames after which a shard is closed.
SHARD_BYTES = 4 << 20
#: Documents that the dictionary is trained on at most (smallest hashes), ids of each, and the dictionary's bytes.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 4096, 64 << 10
LEVEL = 3
MEMO_WORDS = 1_500_000
INDEX = np.dtype([("doc", "<i8"), ("start", "<i8"), ("n", "<i8"), ("at", "<u4"), ("size", "<u4"), ("null", "u1")])
#: Signs after a word, what they may follow, and their number: between the two a match of byte-level BPE always ends.
SIGNS, MOST_SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~", 3
WORD_END = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").union(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7))
#: Pieces that are one match, after a line break two. GROUP_CHARS: characters of texts that are encoded together.
_PLAIN = re.compile("\n?(?:[A-Za-zÀ-ÖØ-öø-ſ]+|[0-9]+)").fullmatch
GROUP_CHARS = 1 << 18
_tokenizers: dict[str, object] = {}
#: White space or what some library counts as such: between two of them a cut could split a match.
_BLANK = re.compile("[\\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
_BLANKS = tuple(filter(_BLANK.match, map(chr, range(1 << 16))))
_ASCII_BLANKS = tuple(c for c in _BLANKS if c.isascii())


def bytes_char() -> list[str]:
    """The letter that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE treats each match of its pattern alone, and a space after a non-space always begins a
    new match; by its plain pattern so does a line break between two non-spaces. So a text is cut before these,
    and the library encodes each distinct piece once (up to MEMO_WORDS remembered pieces) without changing any id.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        # A special token between pieces lets the library take many in one call; the pieces' ids are cut at its id.
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = plain[0] if plain else (None, None)
        self.sizes = self._sizes()
        if self.sizes is not None:
            # The same model without the pattern, for matches that are told apart by spaces and spelt in its letters for bytes.
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = CharDelimiterSplit(" ")
            spelt = bytes_char()
            self.letters = "".join("Ġ" if b == 1 else " " if b == 32 else spelt[b] for b in range(256))
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces that come here are new; the library's own memory of words costs more than it saves

    def _sizes(self) -> np.ndarray | None:
        """The bytes of each id's text, where the file is plain byte-level BPE: pieces that are encoded as one text are told apart by them."""
        rules = json.loads(self.tokenizer.to_str())
        split, model = rules["pre_tokenizer"] or {}, rules["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and model["type"] == "BPE"
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if not plain or "Ċ" not in model["vocab"] or rules["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) or any(set(x) & set(" \n" + SIGNS) for x in added.values()):
            return None
        sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            sizes[i] = len(token)
        for i, content in added.items():
            sizes[i] = len(content.encode())
        return sizes

    def _told_apart(self, ids: list[int], lengths: list[int]) -> list[bytes] | None:
        """The ids of pieces of so many bytes; None if some id goes beyond its piece."""
        ids, ends = np.array(ids, self.width), np.cumsum(lengths)
        reach = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        cut = np.searchsorted(reach, ends, side="right") - 1
        if cut[-1] != len(ids) or (reach[cut] != ends).any():
            return None
        raw, cut = ids.tobytes(), (cut * self.width.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def _joined(self, pieces: list[str]) -> list[bytes] | None:
        """The ids of pieces by one text."""
        text = "".join(pieces)
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self._told_apart(ids, [len(p) for p in pieces] if text.isascii() else [len(p.encode()) for p in pieces])

    def _plain(self, pieces: list[str]) -> list[bytes] | None:
        """The ids of pieces that _PLAIN matches: the library needs no pattern to find their matches."""
        text = " ".join(["\n " + p[1:] if p[0] == "\n" else "\x01" + p for p in pieces])
        lengths = [len(p) + (p[0] != "\n") for p in (pieces if text.isascii() else [p.encode().decode("latin-1") for p in pieces])]
        spelt = codecs.charmap_decode(text.encode(), "strict", self.letters)[0]
        return self._told_apart(self.words.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, lengths)

    def _library(self, pieces: list[str], marked: bool) -> list[bytes]:
        if self.sizes is not None and (found := self._joined(pieces)) is not None:
            return found
        if not marked:
            return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0].ids, self.width)
        size = self.width.itemsize
        ends = (np.flatnonzero(ids == self.mark_id) * size).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + size for e in ends)], [*ends, len(raw)], strict=True)]

    def _stems(self, pieces: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
        """Pieces that the library has to encode, and others as words with signs after them, the words being remembered or among the first."""
        wanted, signed = {}, []
        for p in pieces:
            stem = p.rstrip(SIGNS)
            if stem is p or stem[-1:] not in WORD_END or len(p) - len(stem) > MOST_SIGNS:
                wanted[p] = None
                continue
            sign = p[len(stem) :]
            if sign not in self.signs:
                self.signs[sign] = self._library([sign], False)[0]
            signed.append((p, stem, sign))
            if stem not in self.memo:
                wanted[stem] = None
        return list(wanted), signed

    def _cut(self, text: str) -> list[str]:
        """The first piece, and the others without the space before them; those after a line break begin with it."""
        found = [c for c in (_ASCII_BLANKS if text.isascii() else _BLANKS) if c in text]
        if not any(c + " " in text for c in found) and " \n" not in text:
            if self.sizes is not None and not any(c + "\n" in text or "\n" + c in text for c in found):
                text = text.replace("\n", " \n")
            return text.split(" ")
        first, *rest = text.split(" ")
        pieces = [first]
        for part in rest:
            if not pieces[-1] or part[:1] == "\n" or _BLANK.match(pieces[-1][-1]):
                pieces[-1] += " " + part
            else:
                pieces.append(part)
        return pieces

    def _ids(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't remembered, and of words in them; they are remembered from now on if there is room."""
        memo = self.memo
        wanted, signed = self._stems(missing) if self.sizes is not None else (missing, [])
        plain = [p for p in wanted if _PLAIN(p)] if self.sizes is not None else []
        new = dict(zip(plain, self._plain(plain) or (), strict=False)) if plain else {}
        others = [p for p in wanted if p not in new]
        if others:
            marked = self.mark is not None and not any(self.mark in p for p in others)
            new.update(zip(others, self._library([p if p[:1] == "\n" else " " + p for p in others], marked), strict=True))
        for piece, stem, sign in signed:
            ids = new.get(stem)
            new[piece] = (memo[stem] if ids is None else ids) + self.signs[sign]
        if len(memo) < MEMO_WORDS:
            memo.update(item for item in new.items() if len(item[0]) < 40)
        return new

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of `width`."""
        first, *rest = self._cut(text)
        # The last piece may end in white space: it has nothing after it, so it stays the last one.
        tail = [rest.pop()] if rest and (not rest[-1] or _BLANK.match(rest[-1][-1])) else []
        found = list(map(self.memo.get, rest))  # of pieces without the space before them
        gaps = [k for k, ids in enumerate(found) if ids is None]
        if gaps:
            new = self._ids(list(dict.fromkeys([rest[k] for k in gaps])))
            for k in gaps:
                found[k] = new[rest[k]]
        marked = self.mark is not None and self.mark not in text
        begin, *end = self._library([first, *(p if p[:1] == "\n" else " " + p for p in tail)], marked)
        return b"".join([begin, *found, *end])

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; new pieces of all go to the library together."""
        out, rows, missing = [], [], {}
        for text in texts:
            # After a line break a text's first piece is one like others; the break's id, one of a byte, is taken off below.
            first, *rest = self._cut("\n" + text)
            if first or not rest[-1] or _BLANK.match(rest[-1][-1]):
                out.append(self.encode(text))
                continue
            found = list(map(self.memo.get, rest))
            gaps = [k for k, ids in enumerate(found) if ids is None]
            missing.update(dict.fromkeys([rest[k] for k in gaps]))
            rows.append((len(out), rest, found, gaps))
            out.append(b"")
        new = self._ids(list(missing)) if missing else {}
        for at, rest, found, gaps in rows:
            for k in gaps:
                found[k] = new[rest[k]]
            out[at] = b"".join(found)[self.width.itemsize :]
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of each text."""
        if self.sizes is None:
            yield from map(self.encode, texts)
            return
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for serialized id arrays; raw content of the samples where they are too few to train on."""
    if sum(map(len, samples)) >= 8 * 1024:
        try:
            size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICT_BYTES:] or b"\0" * 8


class Shard:
    """Writes one shard."""

    def __init__(self, compressor: zstandard.ZstdCompressor, dict_hash: str, width: int):
        self.compressor, self.dict_hash, self.width = compressor, dict_hash, width
        self.rows: list[tuple] = []
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, doc: int | None, start: int, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.rows.append((doc or 0, start, len(ids) // self.width, self.size, len(frame), doc is None))
        self.frames.append(frame)
        self.size += len(frame)

    def payload(self) -> bytes:
        header = json.dumps({"dictionary": self.dict_hash, "width": self.width, "documents": len(self.rows)}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, np.array(self.rows, INDEX).tobytes(), *self.frames])


class ShardReader:
    """Reads one shard; a document is found by the index and decompressed alone."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token shard")
        (length,) = struct.unpack_from("<I", payload, 8)
        self.header = json.loads(payload[12 : 12 + length])
        if self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the shard was written with another dictionary")
        self.index = np.frombuffer(payload, INDEX, self.header["documents"], 12 + length)
        self._frames = memoryview(payload)[12 + length + self.index.nbytes :]
        self._decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.dtype = np.dtype(f"<u{self.header['width']}")

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard."""
        row = self.index[k]
        at = int(row["at"])
        return np.frombuffer(self._decompressor.decompress(self._frames[at : at + int(row["size"])]), self.dtype)

    def find(self, doc: int) -> np.ndarray:
        k = int(np.flatnonzero((self.index["doc"] == doc) & (self.index["null"] == 0))[0])
        return self.ids(k)


def _sample_kernel(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            end = np.array([end_id], own.width).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([(ids + end)[: SAMPLE_IDS * own.width.itemsize] for ids in own.encode_all(v.as_py() or "" for v in batch.column(0))], pa.binary())], names=["ids"])

    return run


def _write_kernel(path: str, end_id: int, dictionary: bytes, shard_bytes: int):
    dict_hash = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = encoder(path)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        end = np.array([end_id], own.width).tobytes()
        shard, start, number = None, 0, 0

        def closed() -> pa.RecordBatch:
            ids = sum(r[2] for r in shard.rows)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([ids]), pa.array([shard.payload()], pa.binary())], names=["part", "shard", "n_ids", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode_all(value.as_py() or "" for value in batch.column(1)), strict=True):
                shard = shard or Shard(compressor, dict_hash, own.width.itemsize)
                ids += end
                shard.add(doc, start, ids)
                start += len(ids) // own.width.itemsize
                if shard.size >= shard_bytes:
                    yield closed()
                    shard, number = None, number + 1
        if shard:
            yield closed()

    return run


def _read_kernel(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(payload.as_py(), dictionary)
                index = reader.index
                crc = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(index))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(index), part, np.int64)), pa.array(index["doc"], mask=index["null"] != 0), pa.array(index["start"]), pa.array(index["n"]), pa.array(crc, pa.int64())],
                    names=["part", "id", "local", "n_tokens", "ids_crc32"],
                )

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes shards in ascending id order under path.

    Texts are range-partitioned by id and sorted within partitions; ties are ordered by the text. Null ids come
    first. The dictionary is trained on at most SAMPLE_DOCS documents, those of smallest hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = docs.count()
    hashed = source.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    # About twice as many as needed pass the filter, so few texts are sorted.
    cut = int(min(1.0, 2 * SAMPLE_DOCS / max(1, rows)) * (1 << 30))
    sampled = hashed.where(F.col("h") < cut).orderBy("h", "id").limit(SAMPLE_DOCS).select("text")
    samples = sampled.mapInArrow(_sample_kernel(tokenizer_file, end_id), "ids binary").toArrow().column("ids").to_pylist()
    dictionary = train_dictionary(sorted(samples))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    number = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(number, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(_write_kernel(tokenizer_file, end_id, dictionary, shard_bytes), "part bigint, shard bigint, n_ids bigint, payload binary").write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files under path.

    start counts the ids of all documents before it: the ids before it in its partition, in the index, and
    those of earlier partitions, a prefix sum over as many numbers as there are partitions.
    """
    prepare(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shards = spark.read.schema("part bigint, shard bigint, n_ids bigint, payload binary").parquet(f"{path}/shards")
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, base = 0, []
    for part in sorted(totals):
        base.append((part, before))
        before += totals[part]
    offsets = spark.createDataFrame(base, "part bigint, before bigint")
    found = shards.select("part", "payload").mapInArrow(_read_kernel(dictionary), "part bigint, id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(offsets), "part").select("id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """write() to a new folder under the scratch folder, then read(): one row for each row of docs."""
    path = f"{scratch_dir(docs.sparkSession)}/tallyweave/{uuid.uuid4().hex}-tokens"
    write(docs, path, tokenizer_file, id_col, text_col, **options)
    return read(docs.sparkSession, path).withColumnRenamed("id", id_col)

"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut where white space begins: no match of the pattern spans such a place and none looks
across it from the left, so the ids are those of the whole text. A very long run of white space, on which the
library's pattern engine runs out of stack, is one match by the pattern's own last rules (all of it at the end of a
text, else all but its last character) and goes to the ranks directly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare, texts_of

#: Code points beyond which a text is encoded in pieces.
PIECE = 50_000
#: Code points of white space from which a run bypasses the pattern.
RUN = 10_000
#: The characters that the pattern's \\s stands for (Unicode White_Space), and its last alternatives.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RULES = r"\s+(?!\S)|\s+"
_SAFE = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
_LONG = re.compile(f"[{SPACES}]{{{RUN},}}")
_encoders: dict[tuple[str, str], object] = {}


def load(rank_file: str, pattern: str):
    """A tiktoken encoding without special tokens, read once in each worker."""
    key = (rank_file, pattern)
    if key not in _encoders:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _encoders[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of `size` code points or more, each but the last ending at a safe boundary."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoding, text: str) -> list[int]:
    """The ids of the whole text. Patterns with other rules for white space are left to the library."""
    if len(text) <= RUN or not encoding._pat_str.endswith(SPACE_RULES):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _LONG.finditer(text):
        for piece in pieces(text[start : run.start()]):
            ids += encoding.encode_ordinary(piece)
        start = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding._encode_single_piece(text[run.start() : start].encode())
    for piece in pieces(text[start:]):
        ids += encoding.encode_ordinary(piece)
    return ids


def decode(encoding, ids: list[int]) -> bytes:
    """The raw bytes of the ids; they needn't be whole characters."""
    return encoding.decode_bytes(ids)


def _kernel(rank_file: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            counts, lists, shas, decoded = [], [], [], []
            for text in texts_of(batch, "text"):
                ids = encode(encoding, text)
                counts.append(len(ids))
                if with_ids:
                    lists.append(ids)
                    continue
                shas.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(encoding, ids)).hexdigest())
            rest = [pa.array(lists, pa.list_(pa.int32()))] if with_ids else [pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *rest], names=["id", "n_tokens", *(["ids"] if with_ids else ["ids_sha256", "decoded_sha256"])])

    return run


def _run(docs: DataFrame, rank_file: str, pattern: str, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    prepare(docs.sparkSession)
    rest = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), *rest])
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(_kernel(rank_file, pattern, with_ids), schema)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every whole text; null counts as empty and has no ids. One pass, no shuffle.

    rank_file must be readable at this path on every executor. Repeated rows are encoded each.
    """
    return _run(docs, rank_file, pattern, id_col, text_col, True)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes that they decode to."""
    return _run(docs, rank_file, pattern, id_col, text_col, False)

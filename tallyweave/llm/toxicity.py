"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over the words of a text and their leading letters. For labelled texts that
mention a group of people, a second version with the mention swapped for another group of the same kind
is made, and the squared change of the score between the two is part of the loss: the model learns
nothing from who is mentioned, which keeps neutral mentions below the threshold.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare, texts_of

#: Terms for groups of people, by kind; a mention is swapped for the next of its kind.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "queer"], ["transgender", "cisgender"],
    ["black", "white", "asian", "latino", "arab"], ["african", "european", "american", "mexican", "chinese", "indian"],
    ["immigrants", "locals", "refugees"], ["immigrant", "local", "refugee"], ["disabled", "deaf", "blind"], ["old", "young"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]
SWAP = {term: group[(k + 1) % len(group)] for group in IDENTITY_TERMS for k, term in enumerate(group)}

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that training reads at most, by smallest hash of the id.
SAMPLE_PER_CLASS = 3000
PREFIXES = (4, 5, 6)
MEMO_WORDS = 300_000


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its leading letters."""
    raw = word.encode("utf-8", "surrogatepass")
    return [crc32(b"w" + raw), *(crc32(b"p" + word[:k].encode("utf-8", "surrogatepass")) for k in PREFIXES if len(word) > k)]


def text_features(words: set[str]) -> np.ndarray:
    found: set[int] = set()
    for word in words:
        found.update(word_features(word))
    return np.array(sorted(found), np.uint32)


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def scores(self, texts: Iterator[str], memo: dict[str, tuple[int, ...]]) -> list[float]:
        out = []
        weights = self.weights
        for text in texts:
            found: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                hits = memo.get(word)
                if hits is None:
                    hits = tuple(f for f in word_features(word) if f in weights)
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = hits
                if hits:
                    found.update(hits)
            total = self.bias + sum(sorted(weights[f] for f in found))
            out.append(1 / (1 + np.exp(-total)) if total > -700 else 0.0)
        return out


def fit(rows: list[np.ndarray], changes: list[tuple[np.ndarray, np.ndarray] | None], toxic: np.ndarray, *, l1: float = 2e-4, l2: float = 1e-5, counterfactual: float = 1.0, keep: int = 4000, steps: int = 400) -> Model:
    """Fits the model to feature sets. changes: the features that a text loses and gains when its mentions are swapped, or None without a mention.

    loss = class-balanced mean log loss + l1 |w| + l2 w^2 / 2 + counterfactual * mean (f(x) - f(swapped x))^2 / 2,
    by accelerated proximal gradient steps. Only the `keep` features that differ most between the classes
    enter. Without rows of both classes the score is the share of toxic rows, 0 without rows.
    """
    positive = int(toxic.sum())
    if not len(rows) or positive in (0, len(rows)):
        share = positive / len(rows) if len(rows) else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), {})
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, column = np.unique(flat, return_inverse=True)
    seen = np.bincount(column, minlength=len(names)).astype(float)
    bad = np.bincount(column, weights=toxic[owner].astype(float), minlength=len(names))
    p, q = (bad + 0.5) / (positive + 1), (seen - bad + 0.5) / (len(rows) - positive + 1)
    z = np.abs(np.log(p / q)) / np.sqrt(1 / (bad + 0.5) + 1 / (seen - bad + 0.5))
    z[seen < min(3, positive)] = -1
    chosen = np.sort(np.argsort(-z, kind="stable")[:keep])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[column] >= 0
    col, row = place[column[use]], owner[use]
    names = names[chosen]

    def columns(features: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, features)
        at[at == len(names)] = 0
        return at[names[at] == features]

    pairs = [(columns(lost), columns(gained)) for lost, gained in (x for x in changes if x is not None)]
    none = np.zeros(0, np.int64)
    d_col = np.concatenate([none, *(x for pair in pairs for x in pair)])
    d_row = np.repeat(np.arange(len(pairs)), [len(x) + len(y) for x, y in pairs])
    d_val = np.concatenate([none, *(np.r_[np.ones(len(x)), -np.ones(len(y))] for x, y in pairs)])
    n, m = len(rows), len(chosen)
    share = np.where(toxic, 0.5 / positive, 0.5 / (n - positive))
    sign = np.where(toxic, 1.0, -1.0)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        f = b + np.bincount(row, weights=w[col], minlength=n)
        pull = -sign * share / (1 + np.exp(np.clip(sign * f, -30, 30)))
        g = np.bincount(col, weights=pull[row], minlength=m) + l2 * w
        if pairs:
            change = np.bincount(d_row, weights=d_val * w[d_col], minlength=len(pairs))
            g += counterfactual * np.bincount(d_col, weights=d_val * change[d_row], minlength=m) / len(pairs)
        return g, float(pull.sum())

    w, b = np.zeros(m), 0.0
    at_w, at_b, t = w, b, 1.0
    # The largest curvature: of the log loss at most a quarter of the weighted squared norm of the rows.
    v = np.ones(m) / np.sqrt(m)
    for _ in range(12):
        u = np.bincount(col, weights=(share * (np.bincount(row, weights=v[col], minlength=n)))[row], minlength=m) / 4
        if pairs:
            u += counterfactual * np.bincount(d_col, weights=d_val * np.bincount(d_row, weights=d_val * v[d_col], minlength=len(pairs))[d_row], minlength=m) / len(pairs)
        top = np.linalg.norm(u)
        v = u / top if top else v
    step = 1 / (1.2 * max(top, 0.05) + 0.5 + l2)
    for _ in range(steps):
        g, gb = gradient(at_w, at_b)
        new_w = at_w - step * g
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_b = at_b - step * gb
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return Model(float(b), {int(f): float(x) for f, x in zip(names, w, strict=True) if x})


def _feature_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature hashes as 32-bit integers, and which of them a swap of the mentions takes away and adds (null without a mention)."""
    kind = pa.list_(pa.int32())
    for batch in batches:
        own, lost, gained = [], [], []
        for text in texts_of(batch, "text"):
            words = set(WORD.findall(text.lower()))
            have = text_features(words)
            own.append(have.view(np.int32))
            if words & SWAP.keys():
                other = text_features({SWAP.get(w, w) for w in words})
                lost.append(np.setdiff1d(have, other).view(np.int32))
                gained.append(np.setdiff1d(other, have).view(np.int32))
            else:
                lost.append(None)
                gained.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x in (own, lost, gained))], names=["toxic", "own", "lost", "gained"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS, **options) -> Model:
    """Trains on the labelled rows whose crc32(id as text) mod 5 is not 0.

    The sample is bounded: at most sample_per_class ids of each class, those of smallest hash. Rows
    without a label or id are left out; an id labelled twice counts as toxic if one label says so, and a row of docs
    that repeats an id is learnt from each time.
    """
    prepare(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    own = own.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    # The smallest hashes of each class: every partition keeps so many, and they are merged.
    hashed = own.select("id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("id").alias("h"))
    least = lambda label: hashed.where(F.col("toxic") == label).orderBy("h", "id").limit(sample_per_class)
    sample = least(1).unionByName(least(0)).drop("h")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("toxic", "text")
    rows = texts.mapInArrow(_feature_kernel, "toxic int, own array<int>, lost array<int>, gained array<int>").toArrow()
    lists = lambda name: [None if not x.is_valid else x.values.to_numpy().view(np.uint32) for x in rows.column(name)]
    toxic = np.array(rows.column("toxic").to_pylist(), int) > 0
    own_rows, changes = lists("own"), [None if x is None else (x, y) for x, y in zip(lists("lost"), lists("gained"), strict=True)]
    # Rows come in any order; the fit shouldn't depend on it.
    order = sorted(range(len(own_rows)), key=[(bool(y), hashlib.blake2b(f.tobytes(), digest_size=16).digest()) for y, f in zip(toxic, own_rows, strict=True)].__getitem__)
    model = fit([own_rows[k] for k in order], [changes[k] for k in order], toxic[order] if len(order) else toxic, **options)
    del rows, own_rows, changes
    give_back()
    return model


def give_back() -> None:
    """Returns freed memory of the fit to the system; the driver may have long work ahead."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _score_kernel(model: Model, place: int, below: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = pa.array(model.scores(("" if x is None else x for x in (v.as_py() for v in batch.column(place))), memo), pa.float64())
            if below is not None:
                yield batch.filter(pc.less(scores, below))
            else:
                rest = [k for k in range(batch.num_columns) if k != place]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), scores], names=[*(batch.schema.names[k] for k in rest), "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs: the model's probability that the whole text is toxic.

    Null and empty texts get the score of a text without words. Repeated rows are scored each; other
    columns aren't read. No shuffle: one pass over the texts.
    """
    prepare(docs.sparkSession)
    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(_score_kernel(model, 1, None), schema)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose score is below the threshold."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_score_kernel(model, docs.columns.index(text_col), threshold), docs.schema)

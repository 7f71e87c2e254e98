"""N-gram Jaccard self-join by PartEnum signatures.

Sets are dealt into bands of similar size. In a band whose largest set has r items, two sets of Jaccard
similarity t or more differ in at most f(2r) items, f(x) = x(1 - t)/(1 + t). The feature domain is hashed into
partitions for that band, so many that sets fill more than f(2r) of them. A set's signatures are its
projections on the first f(a + b) + 1 partitions that it fills, b its largest possible partner: the sets differ in
at most f(a + b) partitions, so one of these is equal in both, and the partner, which fills it too, has it
among its own. Partitions that both leave empty, in which all sets agree, make no signature. A set
that fills too few partitions also gives its first items in hash order, as partitions of one item each.
A set near the upper end of its band is also put in the next, so every similar pair meets in a band.

Equal sets are one node. In a bucket (the nodes that share a signature) pairs are made with one hub,
which is linear in the bucket; links that hold become components, and only nodes of different
components in a bucket are compared further. Before sets are fetched, pairs are cut by a sketch: items are
counted in bins, and the counts of two sets differ in total by no more than the sets do. What
other hubs leave open is compared with each other: sketches inside each bucket tell which nodes may still
be similar (only a forest over these comes out, never the pairs), and the sets of nodes so connected meet in
blocks, by an inverted index, which returns the links that join components.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .runtime import column_buffers, discard, free_shuffles, list_array, materialize, prepare, small_side

_U = np.uint64
#: Hub rounds before nodes of buckets with several components are compared in blocks, and the nodes of a block.
HUB_ROUNDS = 2
BLOCK_NODES = 256
#: Bins of a sketch (one byte each) for sets from so many items on; bytes of sketches that may be broadcast; nodes of a bucket compared by sketch at once.
SKETCHES = [(0, 64), (400, 512), (4000, 4096)]
BROADCAST_BYTES = 64 << 20
BUCKET_NODES = 1024
#: Passes over the signatures, and how many of one pass that two sets share may be broadcast (about 25 MB as a hashed relation).
PASSES = 4
BROADCAST_SIGNATURES = 1_000_000


def bands(largest: int, similarity: tuple[int, int]) -> list[int]:
    """Lower ends of the size bands up to `largest`; each is 1.6 times as wide as the last, or more for low similarities."""
    num, den = similarity
    ratio = max(1.6, 1.2 * den / num)
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * ratio)))
    ends.append(max(ends[-1] + 1, int(ends[-1] * ratio)))
    return ends


def _combine(*parts: int) -> int:
    value = 0
    for part in parts:
        value = W.mix_int(value * 0x9E3779B97F4A7C15 + part + 1)
    return value


@lru_cache(maxsize=4096)
def _band(band: int, largest: int, most: int) -> tuple[int, np.uint64, np.uint64, np.uint64]:
    """How many partitions a band has, so that a set of its largest size fills more than `most` of them (by six standard deviations), and its seeds."""
    parts = most + 2
    while True:
        load = largest / parts
        free = math.exp(-load)
        spread = math.sqrt(max(0.0, parts * (free - (1 + load) * free * free)))
        if parts * (1 - free) - 6 * spread >= most + 1 or parts >= 4 * largest + 64:
            return parts, _U(_combine(17, band)), _U(_combine(29, band)), _U(_combine(43, band))
        parts += 1 + parts // 32


def signatures(items: np.ndarray, similarity: tuple[int, int], ends: list[int]) -> np.ndarray:
    """PartEnum signatures of one set (distinct 64-bit items) as 64-bit values. Sets too small to differ have none."""
    num, den = similarity
    n = len(items)
    differ = lambda x: x * (den - num) // (den + num)
    own = bisect_right(ends, n) - 1
    partner = n * den // num  # of the largest similar set
    out = []
    for band in (own, own + 1):
        if band > own and partner < ends[band]:
            break
        largest = ends[band + 1] - 1
        most = differ(n + min(partner, largest))
        if most == 0:
            continue  # only equal sets are similar, and these are one node
        parts, seed, mark, single = _band(band, largest, differ(2 * largest))
        hashed = W.mix(items ^ seed)
        part = (((hashed >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
        filled = np.flatnonzero(np.bincount(part))[: most + 1]
        inside = part <= filled[-1]
        total = np.zeros(int(filled[-1]) + 1, _U)
        np.add.at(total, part[inside], W.mix(hashed[inside]))
        out.append(W.mix(total[filled] + W.mix(filled.astype(_U) + mark)))
        if len(filled) <= most:
            out.append(W.mix(np.sort(hashed)[: most + 1] + single))
    return np.concatenate(out) if out else np.zeros(0, _U)


def row_sets(chunk: W.Chunk, n: int) -> Iterator[np.ndarray]:
    """For each row of a chunk its sorted distinct n-word shingles; with fewer words, the whole sequence as one."""
    value, row = W.chunk_shingles(chunk, n)
    cut = np.searchsorted(row, np.arange(chunk.rows + 1))
    word = chunk.bounds()
    for r in range(chunk.rows):
        if cut[r] < cut[r + 1]:
            yield np.unique(value[cut[r] : cut[r + 1]])
        elif word[r] < word[r + 1]:
            yield W.shingles(chunk.hash[word[r] : word[r + 1]], int(word[r + 1] - word[r]))
        else:
            yield np.zeros(0, _U)


def _base_kernel(n: int, similarity: tuple[int, int], in_word: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bands(1 << 20, similarity)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = column_buffers(batch.column(1))
            sizes, first, second, lists, sketches = [], [], [], [], []
            for chunk in W.words(data, bounds, in_word):
                for items in row_sets(chunk, n):
                    sizes.append(len(items))
                    sketches.append(sketch(items))
                    first.append(np.add.reduce(W.mix(items + _U(1))) if len(items) else _U(0))
                    second.append(np.bitwise_xor.reduce(W.mix(items ^ _U(0x5851F42D4C957F2D))) if len(items) else _U(0))
                    if len(items) >= ends[-3]:
                        ends = bands(2 * len(items), similarity)
                    lists.append(signatures(items, similarity, ends) if len(items) else np.zeros(0, _U))
            counts = np.array([len(x) for x in lists], np.int64)
            flat = (np.concatenate(lists) if lists else np.zeros(0, _U)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(first, _U).view(np.int64)), pa.array(np.array(second, _U).view(np.int64)), list_array(flat, counts, pa.int64()), pa.array(sketches, pa.binary())],
                names=["id", "n", "h1", "h2", "sigs", "sketch"],
            )

    return run


def _set_kernel(n: int, in_word: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = column_buffers(batch.column(1))
            blobs = [items.tobytes() for chunk in W.words(data, bounds, in_word) for items in row_sets(chunk, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "items"])

    return run


def _verify_kernel(similarity: tuple[int, int]):
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data_a, bounds_a = column_buffers(batch.column(2))
            data_b, bounds_b = column_buffers(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(data_a[bounds_a[i] : bounds_a[i + 1]], _U)
                b = np.frombuffer(data_b[bounds_b[i] : bounds_b[i + 1]], _U)
                both = len(a) + len(b)
                shared = both - len(np.unique(np.concatenate((a, b))))
                keep[i] = den * shared >= num * (both - shared)
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def sketch(items: np.ndarray) -> bytes:
    """Items counted in bins, more of them for larger sets; a full bin stays at 255, which only makes sketches more alike."""
    bins = [b for least, b in SKETCHES if len(items) >= least][-1]
    count = np.bincount((W.mix(items ^ _U(99)) % _U(bins)).astype(np.int64), minlength=bins)
    return np.minimum(count, 255).astype(np.uint8).tobytes()


def _sketch_rows(column: pa.Array) -> list[np.ndarray]:
    data, bounds = column_buffers(column)
    return [data[bounds[i] : bounds[i + 1]] for i in range(len(column))]


def _folded(rows: list[np.ndarray], bins: int) -> np.ndarray:
    """Sketches as a matrix of `bins` columns, which divide each one's length: bins of equal remainder are summed."""
    out = np.zeros((len(rows), bins), np.int16)
    for length in {len(r) for r in rows}:
        own = [k for k, r in enumerate(rows) if len(r) == length]
        out[own] = np.minimum(np.stack([rows[k] for k in own]).reshape(len(own), -1, bins).sum(axis=1, dtype=np.int64), 255)
    return out


def _small_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sketch) with sketches folded to a few bins, for rows that are many."""
    for batch in batches:
        rows = [_folded([r], 32 if len(r) == SKETCHES[0][1] else 128)[0].astype(np.uint8).tobytes() for r in _sketch_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "sketch"])


def _may_link(difference: np.ndarray, both: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets of sizes that sum to `both` can be similar if they differ in `difference` items or more."""
    num, den = similarity
    return difference * (den + num) <= both * (den - num)


def _prune_kernel(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _sketch_rows(batch.column(3)), _sketch_rows(batch.column(4))
            bins = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
            apart = np.zeros(len(bins), np.int64)
            for size in np.unique(bins):
                own = np.flatnonzero(bins == size)
                apart[own] = np.abs(_folded([left[k] for k in own], size) - _folded([right[k] for k in own], size)).sum(axis=1, dtype=np.int64)
            keep = pa.array(_may_link(apart, batch.column(2).to_numpy(), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sketches: DataFrame, sets, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b, both), those whose sets are similar. both: the sum of their sizes."""
    at = lambda x: sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"{x}_sketch"))
    near = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "both", "a_sketch", "b_sketch").mapInArrow(_prune_kernel(similarity), "a bigint, b bigint")
    near = materialize(near.distinct(), "near")
    free_shuffles(near.sparkSession)
    held = sets(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))))
    left = held.select(F.col("id").alias("a"), F.col("items").alias("left_items"))
    right = held.select(F.col("id").alias("b"), F.col("items").alias("right_items"))
    joined = near.join(left, "a").join(right, "b").select("a", "b", "left_items", "right_items")
    out = materialize(joined.mapInArrow(_verify_kernel(similarity), "a bigint, b bigint"), "links")
    discard(held)
    free_shuffles(near.sparkSession)
    return out


def similar_size(similarity: tuple[int, int]):
    num, den = similarity
    return F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (80, 100), in_word: np.ndarray = W.SPACED) -> DataFrame:
    """Near-duplicate groups: (id, n_shingles, component_id) for each row of docs.

    A document's set holds its distinct n-word shingles (words bounded by ASCII white space, A-Z
    lower-cased; with fewer than n words the whole sequence is one). Documents link if
    den * intersection >= num * union, similarity = (num, den); component_id is the smallest id
    reachable by links. No link is lost: signatures are complete, and in a bucket every two nodes
    are compared unless they are of one component already.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an id are one
    node with several sets. A null id never represents a group and gets a null component unless its
    set is also another row's. An empty table gives an empty result; other columns of docs aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    base = materialize(source.mapInArrow(_base_kernel(n, similarity, in_word), "id bigint, n bigint, h1 bigint, h2 bigint, sigs array<bigint>, sketch binary"), "partenum")
    classes = materialize(base.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = materialize(classes.where("copies > 1").select("h1", "h2", "n", "rep"), "copied")
    # One row for each set, joined once: every pass reads them twice.
    nodes = base.where("size(sigs) > 0").join(small_side(copied), ["h1", "h2", "n"], "left").where("rep is null or rep = id")
    nodes = materialize(nodes.select("id", "n", "sigs"), "nodes")
    members = None
    for turn in range(PASSES):
        # Signatures are dealt by value into passes, so that only a part of them is on disk as shuffle files at a time.
        rows = nodes.select(F.col("id").alias("node"), F.col("n").alias("size"), F.explode("sigs").alias("sig")).where(F.pmod("sig", F.lit(PASSES)) == turn)
        shared = materialize(rows.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("high > low").select("sig"), "shared")
        part = materialize(rows.join(small_side(shared, limit=BROADCAST_SIGNATURES), "sig", "left_semi"), "members")
        members = part if members is None else members.unionByName(part)
        discard(shared)
        free_shuffles(spark)
    full, base = base, materialize(base.drop("sigs"), "lean")
    discard(full, copied, nodes)
    sketches = base.join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "sketch")
    sketches = materialize(sketches, "sketches")
    held = sketches.agg(F.sum(F.length("sketch") + 32)).first()[0] or 0

    def sets(ids: DataFrame) -> DataFrame:
        return materialize(source.join(small_side(materialize(ids.distinct(), "involved")), "id", "left_semi").mapInArrow(_set_kernel(n, in_word), "id bigint, items binary"), "sets")

    if held:
        found = _compare(members, small_side(sketches, held, BROADCAST_BYTES), sets, similarity)
    else:
        found = spark.createDataFrame([], "node bigint, component bigint")
    reached = classes.join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("group"))
    reached = materialize(reached.where("n > 0"), "reached")
    # Equal sets may be a third of all rows: the group table has one row for each set, and AQE splits the larger side.
    own = base.select("id", "n", "h1", "h2").join(reached, ["h1", "h2", "n"], "left")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("group", "id").alias("component_id"))


def _block_kernel(similarity: tuple[int, int]):
    num, den = similarity

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "block"], kind="stable")
        node, block = group["node"].to_numpy(np.int64), group["block"].to_numpy()
        sets = [np.frombuffer(x, _U) for x in group["items"]]
        leader = {c: c for c in group["component"]}
        own = group["component"].to_numpy(np.int64)

        def find(c: int) -> int:
            while leader[c] != c:
                leader[c] = leader[leader[c]]
                c = leader[c]
            return c

        out: list[tuple[int, int]] = []
        if len(leader) > 1:
            size = np.array([len(x) for x in sets])
            _, place = np.unique(np.concatenate(sets), return_inverse=True)
            cut = np.concatenate(([0], np.cumsum(size)))
            holder = np.repeat(np.arange(len(sets)), size)[np.argsort(place, kind="stable")]
            reach = np.concatenate(([0], np.cumsum(np.bincount(place))))
            cross = block.min() != block.max()
            for i in range(len(sets)):
                mine = place[cut[i] : cut[i + 1]]
                first, count = reach[mine], reach[mine + 1] - reach[mine]
                total = int(count.sum())
                spread = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                shared = np.bincount(holder[spread], minlength=len(sets))
                linked = den * shared >= num * (size + size[i] - shared)
                linked &= (block != block[i]) if cross else (np.arange(len(sets)) > i)
                for j in np.flatnonzero(linked):
                    p, q = find(int(own[i])), find(int(own[j]))
                    if p != q:
                        leader[max(p, q)] = min(p, q)
                        out.append((max(node[i], node[j]), min(node[i], node[j])))
        return pd.DataFrame({"a": np.array([x for x, _ in out], np.int64), "b": np.array([y for _, y in out], np.int64)})

    return run


def _forest_kernel(similarity: tuple[int, int]):
    """Rows sorted by bucket, i, j: nodes that may be similar by size and sketch, as a forest over each group's components."""
    names = ["a", "b"]

    def group(rows: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        own, node, size, block, sketch = (rows[k] for k in ("component", "node", "size", "block", "sketch"))
        leaders, place = np.unique(own, return_inverse=True)
        if len(leaders) < 2:
            return []
        leader = np.arange(len(leaders))
        sketch = _folded(list(sketch), min(len(x) for x in sketch))
        out = []
        cross = block.min() != block.max()
        for i in range(len(node)):
            rest = np.flatnonzero((leader[place] != leader[place[i]]) & ((block != block[i]) if cross else (np.arange(len(node)) > i)))
            if not len(rest):
                continue
            rest = rest[_may_link(np.abs(size[rest] - size[i]), size[rest] + size[i], similarity)]
            rest = rest[_may_link(np.abs(sketch[rest] - sketch[i]).sum(axis=1, dtype=np.int64), size[rest] + size[i], similarity)]
            for j in rest:
                p, q = leader[place[i]], leader[place[j]]
                if p != q:
                    leader[leader == max(p, q)] = min(p, q)
                    out.append((int(node[i]), int(node[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def ready(rows: dict[str, np.ndarray], last: bool):
            key = np.stack([rows[k] for k in ("bucket", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1 if key.shape[1] else np.zeros(0, int)
            edges = [0, *cut.tolist(), key.shape[1]]
            stop = len(edges) - 1 if last else len(edges) - 2
            pairs = [x for k in range(stop) for x in group({n: v[edges[k] : edges[k + 1]] for n, v in rows.items()})]
            return pairs, {n: v[edges[stop] :] for n, v in rows.items()}

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=names)

        for batch in batches:
            rows = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names) if n != "sketch"}
            rows["sketch"] = np.empty(batch.num_rows, object)
            rows["sketch"][:] = _sketch_rows(batch.column(batch.schema.get_field_index("sketch")))
            rows = rows if rest is None else {n: np.concatenate((rest[n], v)) for n, v in rows.items()}
            pairs, rest = ready(rows, False)
            yield batch_of(pairs)
        if rest is not None:
            yield batch_of(ready(rest, True)[0])

    return run


def _in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows (key, node, ...) dealt so that every two of a key meet in one group (key, i, j) of at most about 2 * size rows."""
    number = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    dealt = rows.join(number, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _forest(rows: DataFrame, key: str, sketches: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes in rows (key, node, size, component): what connects components whose nodes may be similar, within each key."""
    dealt = _in_blocks(rows, key, BUCKET_NODES).join(sketches.withColumnRenamed("id", "node"), "node")
    ordered = dealt.select(F.col(key).alias("bucket"), "i", "j", "block", "node", F.col("size").cast("int").alias("size"), "component", "sketch").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    near = materialize(ordered.mapInArrow(_forest_kernel(similarity), "a bigint, b bigint").distinct(), "near")
    free_shuffles(rows.sparkSession)
    return near


def _clusters(near: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (node, size, component) with the cluster of each component that `near` connects to another."""
    ends = near.join(placed.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(placed.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").select("ca", "cb")
    clusters = components(ends.distinct()).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    return materialize(placed.join(clusters, "component"), "clusters")


def _block_links(open_rows: DataFrame, sketches: DataFrame, sets, similarity: tuple[int, int]) -> DataFrame:
    """Links between components among the nodes of open buckets: first few bins in each bucket, then all bins and
    at last the sets in each cluster of what is left."""
    placed = materialize(open_rows.select("node", "size", "component").distinct(), "placed")
    small = materialize(sketches.join(placed.select(F.col("node").alias("id")), "id", "left_semi").select("id", "sketch").mapInArrow(_small_kernel, "id bigint, sketch binary"), "small")
    near = None
    for turn in range(PASSES):
        part = _forest(open_rows.where(F.pmod(F.shiftright("sig", 8), F.lit(PASSES)) == turn), "sig", small_side(small), similarity)
        near = part if near is None else near.unionByName(part)
    rough = _clusters(near.distinct(), placed)
    rows = _in_blocks(_clusters(_forest(rough, "cluster", sketches, similarity), placed), "cluster", BLOCK_NODES)
    held = sets(rows.select(F.col("node").alias("id"))).withColumnRenamed("id", "node")
    return rows.select("cluster", "i", "j", "block", "node", "component").join(held, "node").groupBy("cluster", "i", "j").applyInPandas(_block_kernel(similarity), "a bigint, b bigint")


def _compare(members: DataFrame, sketches: DataFrame, sets, similarity: tuple[int, int]) -> DataFrame:
    """Components (node, component) of the links among members (node, size, sig)."""
    spark = members.sparkSession
    links = spark.createDataFrame([], "a bigint, b bigint")
    found = None
    open_rows = members.withColumn("component", F.col("node"))
    for turn in range(HUB_ROUNDS):
        order = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        hubs = open_rows.groupBy("sig").agg(F.min(F.struct(order.alias("o"), "node", "size", "component")).alias("hub")).select("sig", F.col("hub.node").alias("hub"), F.col("hub.size").alias("na"), F.col("hub.component").alias("hub_component"))
        pairs = open_rows.join(hubs, "sig").where("component <> hub_component").withColumnRenamed("size", "nb").where(similar_size(similarity)).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"), (F.col("na") + F.col("nb")).alias("both")).distinct()
        links = links.unionByName(_links(pairs, sketches, sets, similarity))
        found = materialize(components(links), "components")
        # Buckets with one component are done; so are those of two nodes, which have been compared.
        placed = open_rows.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spread = placed.groupBy("sig").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.count(F.lit(1)).alias("held")).where("highest > lowest and held > 2")
        open_rows = materialize(placed.join(spread.select("sig"), "sig", "left_semi"), "open")
        if not open_rows.take(1):
            return found
    links = links.unionByName(materialize(_block_links(open_rows, sketches, sets, similarity), "links"))
    return components(links)

"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, each with a table from segment value to codes. A query looks up its own
segment values, then those at distance 1, 2, ... one table after the other. After the tables 1..a have been
searched to radius r + 1 and the others to r, every code at distance m(r + 1) + a - 1 or less has been
seen (m segments). The search stops when the k-th verified distance is within that bound.

Equal codes are one entry with its k + 1 smallest ids. Entries are dealt into blocks of bounded size, and
queries into blocks too; each pair of blocks is searched on its own and the results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, prepare

#: Distinct codes in a block of the index and in a block of queries, about.
BLOCK_CODES = 16_384
QUERY_BLOCK = 4_096
_U = np.uint64


def sign_code(column: str, bits: int):
    """The signs of a vector's first `bits` components (at most 64) as one long: bit i is set if component i is above 0."""
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (acc, i) -> acc | if(coalesce(get(`{column}`, i), 0) > 0, shiftleft(1L, i), 0L))")


@lru_cache(maxsize=256)
def flips(bits: int, radius: int) -> np.ndarray:
    """All values of `bits` bits with `radius` bits set."""
    if radius == 0:
        return np.zeros(1, np.int64)
    if radius > bits:
        return np.zeros(0, np.int64)
    return np.concatenate([flips(top, radius - 1) | (1 << top) for top in range(bits)])


class CodeIndex:
    """Segment tables over distinct codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        width = min(16, max(4, round(math.log2(max(2, len(codes))))))
        m = max(1, -(-bits // width))
        cuts = [bits * s // m for s in range(m + 1)]
        self.segments = [(cuts[s], cuts[s + 1] - cuts[s]) for s in range(m)]
        self.tables = []
        for low, size in self.segments:
            value = ((codes >> _U(low)) & _U((1 << size) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << size) + 1))))

    def search(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries among which are all at the k smallest distances (k counts entries), with those distances."""
        n, m = len(self.codes), len(self.segments)
        wanted = min(k, n)
        seen = np.zeros(n, bool)
        histogram = np.zeros(self.bits + 1, np.int64)
        places, distances = [], []
        for radius in range(self.bits + 1):
            for a, ((low, size), (order, reach)) in enumerate(zip(self.segments, self.tables, strict=True)):
                values = ((query >> low) & ((1 << size) - 1)) ^ flips(size, radius)
                first, count = reach[values], reach[values + 1] - reach[values]
                some = count > 0
                first, count = first[some], count[some]
                total = int(count.sum())
                if total:
                    spread = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                    fresh = order[spread]
                    fresh = fresh[~seen[fresh]]
                    seen[fresh] = True
                    verified = np.bitwise_count(self.codes[fresh] ^ _U(query)).astype(np.int64)
                    places.append(fresh)
                    distances.append(verified)
                    histogram += np.bincount(verified, minlength=self.bits + 1)
                covered = m * radius + a  # all codes up to this distance are seen
                if histogram[: covered + 1].sum() >= wanted or int(histogram.sum()) == n:
                    place, distance = np.concatenate(places), np.concatenate(distances)
                    kth = np.searchsorted(np.cumsum(histogram), wanted)
                    near = distance <= kth
                    return place[near], distance[near]
        raise AssertionError("every code is within `bits`")


def _search_kernel(bits: int, k: int):
    def run(left: Iterator[pd.DataFrame] | pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        entries, queries = left, right
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "code": pd.Series(dtype="int64"), "distance": pd.Series(dtype="int32")})
        codes = entries["code"].to_numpy(np.int64).view(_U)
        index = CodeIndex(codes, bits)
        out_q, out_c, out_d = [], [], []
        smallest = entries["first"].to_numpy()
        for query in queries["query"].to_numpy(np.int64):
            place, distance = index.search(int(query) & 0xFFFFFFFFFFFFFFFF, k + 1)
            # k + 1 entries hold the k + 1 first ids: each earlier entry has an id before all of a later one.
            order = np.lexsort((smallest[place], distance))[: k + 1]
            out_q.append(np.full(len(order), query))
            out_c.append(codes[place[order]].view(np.int64))
            out_d.append(distance[order])
        return pd.DataFrame({"query": np.concatenate(out_q), "code": np.concatenate(out_c), "distance": np.concatenate(out_d).astype(np.int32)})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "id", code_col: str = "code", block_codes: int = BLOCK_CODES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query row the k rows of smallest Hamming distance.

    rows and queries have an id (long) and a code (long, the lowest `bits` bits count). Ties go to the
    smaller id; a row isn't its own neighbour. Exact: the result is that of comparing all. With fewer than k
    other rows all are returned. Rows with null id or code aren't searched and don't search; rows that repeat
    an id and code count once. Copies of one code, however many, are reduced to their k + 1 smallest ids
    before any search (the window keeps only so many on the map side).
    """
    prepare(rows.sparkSession)
    mask = (1 << bits) - 1 if bits < 64 else -1
    clean = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(code_col).cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")).alias("code")).where("id is not null and code is not null").distinct()
    all_rows, all_queries = clean(rows), clean(queries)
    first = all_rows.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("place") <= k + 1)
    ids = materialize(first.select("code", "id", "place"), "codes")
    entries = ids.groupBy("code").agg(F.min("id").alias("first"))
    asked = materialize(all_queries.select(F.col("code").alias("query")).distinct(), "queries")
    n_entries, n_queries = ids.where("place = 1").count(), asked.count()
    blocks, query_blocks = max(1, -(-n_entries // block_codes)), max(1, -(-n_queries // query_block))
    # More blocks than memory asks for, where there are few: a block is the unit of work.
    blocks = max(blocks, min(8, -(-n_entries // 1024) or 1))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    probes = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = dealt.groupBy("block", "part").cogroup(probes.groupBy("block", "part")).applyInPandas(_search_kernel(bits, k), "query bigint, code bigint, distance int")
    merged = near.join(ids, "code").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("place") <= k + 1)
    pairs = all_queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(merged.select("query", F.col("id").alias("neighbor_id"), "distance"), "query").where("query_id <> neighbor_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", "distance")

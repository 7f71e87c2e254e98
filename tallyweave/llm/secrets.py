"""Secret scan with corpus-wide ownership frequency.

Patterns give candidate spans. The candidates' hashes are counted over the corpus by distinct
repositories and owners: a value that several owners or many repositories hold is a widely copied example; one that a
single owner holds and that looks random is reported as live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, prepare, small_side

#: Kinds in order, with their patterns.
KINDS = ["assign", "access", "hex", "live"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_VALUE = 6
#: Words that mark a value as a placeholder.
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|change_me|placeholder|your|xxxx|test|1234567|abcdef", re.IGNORECASE)
#: Bits a character from which a value looks random.
LIVE_ENTROPY = 2.5
#: Distinct owners up to which a value is specific to its owner.
LIVE_OWNERS = 1
#: Distinct repositories up to which a value of few owners is specific; one in more of them is a copied example.
LIVE_REPOS = 100


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    return entropy(value) >= LIVE_ENTROPY and not PLACEHOLDER.search(value) and any(c.isdigit() for c in value)


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def scan(text: str) -> list[tuple[int, int, int, int, int]]:
    """Base spans (start, kind, end, start and end of the value), by start and kind; offsets in code points."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("h", pa.int64()), ("live", pa.bool_())]))
_SCHEMA = "id bigint, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, cands array<struct<start:bigint,kind:int,end:bigint,from:bigint,to:bigint,h:bigint,live:boolean>>"


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        shas, lists = [], []
        for value in batch.column(3):
            text = value.as_py() or ""
            spans = scan(text)
            for kind in range(3):
                counts[kind].append(sum(s[1] == kind for s in spans))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in spans).encode()).hexdigest())
            lists.append([{"start": s, "kind": k, "end": e, "from": a, "to": b, "h": value_hash(text[a:b]), "live": looks_live(text[a:b])} for s, k, e, a, b in spans])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in range(3)), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(lists, _CANDIDATE)],
            names=["id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "cands"],
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """Per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, max_repos.

    Base spans of a kind are leftmost and non-overlapping over the whole text; a match that is too short is
    dropped. A candidate whose value has at most live_owners distinct owners and live_repos distinct
    repositories in the corpus and looks live adds a span of kind live over the value; one with more of either
    counts in n_example. max_repos is the largest number of repositories that hold a value of the row, 0 without one.
    spans holds all as kind:start:end, by start, then kind, comma-joined; base_sha256 is the digest of
    the base spans written likewise. Null texts count as empty; null owners are one owner, null
    repositories one repository. Repeated rows each get their result. A value copied into very many
    documents is counted per owner before it is shuffled.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    base = materialize(source.mapInArrow(_kernel, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = base.where("size(cands) > 0").select("row", "repo", "owner", F.explode("cands").alias("c"))
    seen = held.select(F.col("c.h").alias("h"), "owner", "repo").distinct()
    owners = seen.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    stats = owners.join(seen.groupBy("h", "repo").agg(F.count(F.lit(1))).groupBy("h").agg(F.count(F.lit(1)).alias("repos")), "h")
    stats = materialize(stats, "owners")
    # Only rows with candidates meet the statistics; the hash may be hot, so its one row is on the other side.
    judged = held.join(small_side(stats.withColumnRenamed("h", "vh")), F.col("c.h") == F.col("vh"))
    copied = (F.col("owners") > live_owners) | (F.col("repos") > live_repos)
    live = ~copied & F.col("c.live")
    added = judged.groupBy("row").agg(
        F.collect_list(F.when(live, F.struct(F.col("c.from").alias("start"), F.lit(3).alias("kind"), F.col("c.to").alias("end")))).alias("more"),
        F.sum(F.when(copied, 1).otherwise(0)).alias("n_example"),
        F.max("repos").alias("max_repos"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    everything = F.sort_array(F.array_union(F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))), F.coalesce("more", none)))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.array_join(F.transform(everything, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return base.join(added, "row", "left").select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
        F.coalesce(F.size(F.array_distinct(F.coalesce("more", none))), F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("bigint").alias("n_example"), F.coalesce("max_repos", F.lit(0)).cast("bigint").alias("max_repos"),
    )

"""Line deduplication against levelled sorted runs, in DataFrame operations only.

Documents come in batches of ascending id. The distinct line keys of a batch are anti-joined with the
runs of earlier batches; keys that no run holds are new, belong to the smallest document of the batch
that has them, and become a run of level 0. When a level holds `fan_out` runs they are merged into one
run of the next, so a key is rewritten once a level and a batch meets few runs. The last batch writes no run.

A run is a Parquet table in the shared scratch folder, its files hash-partitioned and sorted by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import discard, materialize, prepare

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null id: after every other.
LAST_ID = (1 << 63) - 1
#: Rows for which one more batch is made, and the most batches: each costs a round of joins with the runs.
BATCH_ROWS, MOST_BATCHES = 50_000_000, 16


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() equals the ASCII rule where all is ASCII, and is much faster than translate().
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


class LineRuns:
    """The runs: owners of all line keys seen so far. fan_out: runs of a level that are merged at once."""

    def __init__(self, spark: SparkSession, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        return materialize(rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "run")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) whose key no run holds: one merge anti-join with each run."""
        for level in self.levels:
            for run in level:
                keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, owners: DataFrame) -> DataFrame:
        """Adds a run of new keys (h1, h2, owner) and compacts full levels."""
        run = self._write(owners)
        depth = 0
        while True:
            if len(self.levels) == depth:
                self.levels.append([])
            self.levels[depth].append(run)
            if depth == 0:
                added = run
            if len(self.levels[depth]) < self.fan_out:
                return added
            full, self.levels[depth] = self.levels[depth], []
            merged = full[0]
            for other in full[1:]:
                merged = merged.unionByName(other)  # keys of runs are disjoint
            run = self._write(merged)
            depth += 1


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    parts = docs.select("oid", "rid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = parts.select("oid", "rid", "pos", line_key(F.col("line")).alias("key"))
    tried = F.length("key") >= min_chars
    return keyed.where(tried).select("oid", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), F.lit("line"), F.reverse("key")).alias("h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int | None = None, runs: LineRuns | None = None) -> DataFrame:
    """docs with three columns more: __n_lines, __n_dropped and __kept (the text without its dropped lines).

    A key (see line_key) of at least min_chars code points that is in two documents or more loses all
    its lines except in the document of smallest id; in that document every line stays. Other lines
    stay. Keys are compared by 128 bits of hash. A null text is one empty line, its __kept is empty.
    Rows that repeat an id are one document; a null id comes after every other id. With `runs` from
    earlier calls the keys held there count as seen in smaller ids, and new keys are added to them.
    An empty table gives an empty result. Other columns of docs, whatever their names, come through; columns that
    have the names of the three new ones are replaced by them.

    Without `batches` there are four, and one more for each BATCH_ROWS rows beyond (MOST_BATCHES at most). A very common line is aggregated before it is shuffled, and lines meet their owners by key and
    document together, so it needs no task of its own.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = runs is not None
    runs = runs or LineRuns(spark)
    # Rows travel as one struct, so none of their columns can clash with the names used here.
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row").getField(text_col)
    # The same id with the same text has the same lines: (oid, rid) names a row well enough.
    source = source.select("row", F.coalesce(F.col("row").getField(id_col).cast("bigint"), F.lit(LAST_ID)).alias("oid"), F.xxhash64(text).alias("rid"))
    lean = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("oid"), F.xxhash64(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    if batches is None:
        batches = min(MOST_BATCHES, 4 + lean.count() // BATCH_ROWS)
    bounds = []
    if batches > 1:
        found = lean.agg(F.percentile_approx("oid", [k / batches for k in range(1, batches)], 1000)).first()[0]
        bounds = sorted(set(found or []))
    number = sum((F.when(F.col("oid") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    lines = materialize(_lines(lean, min_chars).withColumn("batch", number.cast("int")), "lines")
    dropped = None
    for k in range(len(bounds) + 1):
        own = lines.where(F.col("batch") == k)
        first = own.groupBy("h1", "h2").agg(F.min("oid").alias("owner"))
        new = runs.unseen(first)
        if shared or k < len(bounds):  # no later batch reads the last run: its keys are used as they come
            new = runs.add(new)
        gone = own.join(new.select("h1", "h2", F.col("owner").alias("oid")), ["h1", "h2", "oid"], "left_anti").select("oid", "rid", "pos")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    marks = dropped.distinct().groupBy("oid", "rid").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    joined = source.join(marks, ["oid", "rid"], "left").withColumn("parts", parts)
    # One pass over the dropped places gives runs of kept lines between them; slices avoid a search for each line.
    joined = joined.withColumn("edges", F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("parts"))))
    kept_runs = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice(F.col("parts"), F.element_at(F.col("edges"), i) + 2, F.element_at(F.col("edges"), i + 1) - F.element_at(F.col("edges"), i) - 1))
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(kept_runs), "\n"))
    others = [c for c in docs.columns if c.lower() not in ("__n_lines", "__n_dropped", "__kept")]
    made = joined.select("row", F.size("parts").cast("bigint").alias("n"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("d"), kept.alias("k"))
    made = made.select("row", F.struct("n", "d", "k").alias("made"))  # a list of aliases could be taken for these names
    return made.select(*(F.col("row").getField(c).alias(c) for c in others), *(F.col("made").getField(x).alias(c) for x, c in (("n", "__n_lines"), ("d", "__n_dropped"), ("k", "__kept"))))

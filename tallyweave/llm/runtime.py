"""What the operators of this subpackage share: code shipping, scratch tables, size checks, Arrow access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Spark's default of 10,000 whole documents is too much memory for a Python worker.
BATCH_ROWS = 1000
#: Rows of ids up to which one side of a join may be broadcast (32 MB of longs as a hashed relation); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Makes the package importable in Python workers and bounds their Arrow batches.

    The package is sent as a zip by Spark's own file server, once per context, so executors need no
    shared code folder. The batch size is raised or lowered only where the session has Spark's default.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_tallyweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():
        target = Path(tempfile.mkdtemp(prefix="tallyweave-")) / "tallyweave_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
    context._tallyweave_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir. Where it is unset, a temporary one in local mode only (tests)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(context, "_tallyweave_scratch", None)
        if root is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = context._tallyweave_scratch = "file://" + tempfile.mkdtemp(prefix="tallyweave-scratch-")
    return root.rstrip("/")


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables that are materialized within belong to `owner`, who deletes them with release()."""
    context = spark.sparkContext
    before = getattr(context, "_tallyweave_owner", None)
    context._tallyweave_owner = owner
    try:
        yield
    finally:
        context._tallyweave_owner = before


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet under the scratch folder and reads it again: executors may be lost, the files stay."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallyweave/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyweave_path = path
    context = spark.sparkContext
    owner = getattr(context, "_tallyweave_owner", None)
    if owner is not None:
        context._tallyweave_tables = [*getattr(context, "_tallyweave_tables", []), (owner, path)]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    context._tallyweave_tables = [x for x in getattr(context, "_tallyweave_tables", []) if x[1] != path]


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tallyweave_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession, owner: str) -> None:
    """Deletes the scratch tables of `owner`, whose results are all written elsewhere. Those of other callers stay."""
    for name, path in list(getattr(spark.sparkContext, "_tallyweave_tables", [])):
        if name == owner:
            _delete(spark, path)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context drop shuffle files of finished plans; Spark does so when the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_IDS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows (counted), else df as it is (a shuffle join)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (length + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(kind)
    else:
        column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for value in batch.column(batch.schema.get_field_index(name)):
        text = value.as_py()
        yield "" if text is None else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Partitions for stages of few bytes and much work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

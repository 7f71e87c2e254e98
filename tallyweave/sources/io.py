"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array of items, with a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def with_predictions(items_df: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Items for which a prediction exists."""
    return items_df.join(predictions.select(key), key, "left_semi")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; empty cells are null."""
    df = spark.read.csv(path, header=True)
    return df.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't under path yet (a resumable sink); returns how many."""
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows = rows.dropDuplicates([key])
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


WEBHOOK = "entry array<struct<changes:array<struct<value:struct<messages:array<struct<id:string,from:string,type:string,text:struct<body:string>,image:struct<id:string>,interactive:struct<button_reply:struct<id:string>,list_reply:struct<id:string>>>>>>>>>"


def webhook_messages(rows: DataFrame, body: str) -> DataFrame:
    """(id, sender, type, content) of the text, button and image messages in webhook bodies."""
    parsed = rows.select(F.from_json(body, WEBHOOK).alias("b")).select(F.explode("b.entry").alias("e")).select(F.explode("e.changes").alias("c")).select(F.explode("c.value.messages").alias("m"))
    content = F.when(F.col("m.type") == "text", F.col("m.text.body")).when(F.col("m.type") == "interactive", F.coalesce("m.interactive.button_reply.id", "m.interactive.list_reply.id")).when(F.col("m.type") == "image", F.col("m.image.id"))
    return parsed.where(F.col("m.type").isin("text", "interactive", "image")).select(F.col("m.id").alias("id"), F.col("m.from").alias("sender"), F.col("m.type").alias("type"), content.alias("content"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, sha, content) of the files of a folder; the first path of equal contents is kept by first_files()."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha"), "content")


def first_files(found: DataFrame) -> DataFrame:
    """One file of each distinct content: that of the smallest path (contents aren't shuffled)."""
    first = found.groupBy("sha").agg(F.min("path").alias("path"))
    return found.join(first, ["sha", "path"], "left_semi")


def predictions(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The result files of a run, one JSON document each, with `id` from the file's name."""
    found = spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True)
    return found.withColumn("id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def save_weights(spark: SparkSession, path: str, names: list[str], weights: list[float], intercept: float) -> None:
    spark.createDataFrame([(names, [float(w) for w in weights], float(intercept))], "names array<string>, weights array<double>, intercept double").coalesce(1).write.mode("overwrite").json(path)


def load_weights(spark: SparkSession, path: str, names: list[str]) -> tuple[list[float], float]:
    """The weights of a model; an error if it was made for other features or another order."""
    row = spark.read.schema("names array<string>, weights array<double>, intercept double").json(path).first()
    if row is None or list(row["names"] or []) != names or len(row["weights"] or []) != len(names):
        raise ValueError(f"the model at {path} was made for other features")
    return list(row["weights"]), row["intercept"]


def cache_key(*parts: str):
    return F.sha2(F.concat_ws("|", *parts), 256)


def not_cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The distinct requests that no cached answer covers: only these reach the reader."""
    return requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def from_cache(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Every request with its answer; the cache has one answer for a key."""
    return requests.join(cache, key, "left")


def markdown(table: DataFrame, rows: int = 1000) -> str:
    """A small result as a Markdown table (a report: at most `rows` rows, more is an error)."""
    found = table.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows in a report")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + " - |" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])


def between_markers(text: str, name: str, block: str) -> str:
    """A document with what stands between its markers replaced."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if begin not in text or end not in text:
        raise ValueError(f"no markers {name}")
    return text[: text.index(begin) + len(begin)] + "\n" + block + "\n" + text[text.index(end) :]


def append_run(spark: SparkSession, path: str, commit: str, dirty: bool, models: list[str]) -> None:
    """Appends the metadata of a run."""
    spark.createDataFrame([(commit, dirty, models)], "commit string, dirty boolean, models array<string>").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)

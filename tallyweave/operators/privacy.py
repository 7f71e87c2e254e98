"""k-anonymous aggregates: means per person first, then counts with suppression, always in that order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 5


def suppressed(count: Column, k: int = K) -> Column:
    """Null where 0 < count < k; a zero may be shown."""
    return F.when(~count.between(1, k - 1), count)


def entity_means(rows: DataFrame, entity: str, value: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.avg(value).alias("mean"))


def histogram(rows: DataFrame, value: str, edges: Sequence[float], k: int = K) -> DataFrame:
    """(bin, lo, hi, n) for every bin, in one aggregation: half-open, the last closed, values outside dropped, small counts null."""
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    v = F.col(value)
    inside = [(v >= lo) & ((v <= hi) if i == len(pairs) - 1 else (v < hi)) for i, (lo, hi) in enumerate(pairs)]
    counts = rows.agg(F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.count_if(c).alias("n")) for i, ((lo, hi), c) in enumerate(zip(pairs, inside, strict=True)))).alias("bins"))
    return counts.select(F.inline("bins")).withColumn("n", suppressed(F.col("n"), k))


def total_of(bins: DataFrame, people: DataFrame, value: str, k: int = K) -> DataFrame:
    """One row (n, mean): n is null if any bin is hidden, the mean if there are fewer than k people."""
    hidden = bins.agg(F.bool_or(F.col("n").isNull()).alias("hidden"))
    return people.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).crossJoin(hidden).select(F.when(~F.col("hidden"), F.col("n")).alias("n"), F.when(F.col("n") >= k, F.col("mean")).alias("mean"))


def any_of(rows: DataFrame, entity: str, positive: Column, negative: Column) -> DataFrame:
    """(entity, result): positive if any row is, else negative if any is, else not_done."""
    rank = F.max(F.when(positive, 2).when(negative, 1).otherwise(0))
    return rows.groupBy(entity).agg(F.element_at(F.array(F.lit("not_done"), F.lit("negative"), F.lit("positive")), rank + 1).alias("result"))


def cell_counts(rows: DataFrame, group: str, cell: str, cells: Sequence[str], k: int = K) -> DataFrame:
    """Per group a suppressed count of each cell, and tested: null if a cell is hidden or the total is small."""
    counted = rows.groupBy(group).agg(*(F.count_if(F.col(cell) == c).alias(c) for c in cells))
    hide = [F.col(c).between(1, k - 1) for c in cells]
    total = sum((F.col(c) for c in cells), F.lit(0))
    any_hidden = F.array_contains(F.array(*hide), True)
    return counted.select(group, *(suppressed(F.col(c), k).alias(c) for c in cells), F.when(~any_hidden & ~total.between(1, k - 1), total).alias("tested"))


# The edges of the published bins.
BINS = {"systolic": [0, 90, 100, 110, 120, 130, 140, 160, 400], "diastolic": [0, 60, 70, 80, 90, 100, 400], "temperature": [0, 36.0, 36.5, 37.0, 37.5, 38.0, 45]}
TESTS = ["hiv", "syphilis", "hbsag"]


def bin_label(lo: Column, hi: Column) -> Column:
    """<90, 90–100, ... and ≥160 for the last, which is open."""
    plain = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.when(lo == 0, F.concat(F.lit("<"), plain(hi))).when((hi >= 300) | (hi == 45), F.concat(F.lit("≥"), plain(lo))).otherwise(F.concat(plain(lo), F.lit("–"), plain(hi)))


def indicators(fields: DataFrame, patient: str = "patient_id") -> DataFrame:
    """One row for each woman from known fields (field_id, status, value): means of her pressures and temperature, and her tests.

    A test is positive if any of hers is, else negative if any is; null without one.
    """
    known = fields.where("status = 'KNOWN'").withColumn("name", F.substring_index("field_id", ".", -1))
    pressure = F.when((F.col("name") == "bp") & F.col("value").rlike(r"^\d{2,3}/\d{2,3}$"), F.split("value", "/"))
    warm = F.when((F.col("name") == "temperature") & ~F.col("field_id").contains("newborn"), F.col("value").try_cast("double"))
    # Women without a known field count as women: the groups are those of all fields.
    means = known.groupBy(patient).agg(
        F.avg(pressure[0].cast("double")).alias("systolic"), F.avg(pressure[1].cast("double")).alias("diastolic"), F.avg(warm).alias("temperature"),
        *(F.max(F.when(F.col("name") == t, F.when(F.col("value") == "positive", 2).when(F.col("value") == "negative", 1).otherwise(0))).alias(t) for t in TESTS),
    )
    result = lambda t: F.when(F.col(t) == 2, "positive").when(F.col(t) == 1, "negative").when(F.col(t) == 0, "not_done").alias(t)
    return fields.select(patient).distinct().join(means, patient, "left").select(patient, *BINS, *(result(t) for t in TESTS))


def registered(fields: DataFrame, k: int = K) -> dict[str, DataFrame]:
    """The published tables: bins of each indicator with labels, test counts, and one row of totals."""
    women = indicators(fields)
    bins = {name: histogram(women, name, edges, k).select("bin", bin_label(F.col("lo"), F.col("hi")).alias("label"), "n") for name, edges in BINS.items()}
    long = women.select(F.inline(F.array(*(F.struct(F.lit(t).alias("test"), F.col(t).alias("result")) for t in TESTS)))).where("result is not null")
    hidden = bins["systolic"].unionByName(bins["diastolic"]).agg(F.bool_or(F.col("n").isNull()).alias("hidden"))
    counted = women.agg(F.count(F.lit(1)).alias("w"), F.count("systolic").alias("n"), F.avg("systolic").alias("s"), F.avg("diastolic").alias("d"), F.count("temperature").alias("n_temperature"))
    totals = counted.join(F.broadcast(hidden)).select(  # one row each
        suppressed(F.col("w"), k).alias("women"), F.when(~F.col("hidden"), F.col("n")).alias("n_bp"), F.when(F.col("n") >= k, F.round("s", 1)).alias("mean_systolic"), F.when(F.col("n") >= k, F.round("d", 1)).alias("mean_diastolic"), "n_temperature",
    )
    return {**bins, "tests": cell_counts(long, "test", "result", ["positive", "negative", "not_done"], k), "totals": totals}


def code_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a coded test result: 1 positive, 0 negative, all else not done."""
    c = F.col(column)
    return rows.agg(F.count_if(c == "1").alias("positive"), F.count_if(c == "0").alias("negative"), F.count_if(~F.coalesce(c.isin("0", "1"), F.lit(False))).alias("not_done"))


def scrubbed(value: Column, value_type: Column, scrub) -> Column:
    """Free texts without personal numbers; codes and typed values stay."""
    return F.when(value_type == "text", scrub(value)).otherwise(value)

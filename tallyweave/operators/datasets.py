"""Assembling evaluation sets: containment joins, splits, content dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained(points: DataFrame, boxes: DataFrame, on: list[str], pad: float = 0.0, how: str = "inner") -> DataFrame:
    """Points (x, y) in boxes (x0, y0, x1, y1) of the same page, or with how='left_anti' those in none. boxes: a catalogue of fixed size, broadcast."""
    same = [points[c] == boxes[c] for c in on]
    inside = (points["x"] >= boxes["x0"] - pad) & (points["x"] <= boxes["x1"] + pad) & (points["y"] >= boxes["y0"] - pad) & (points["y"] <= boxes["y1"] + pad)
    condition = inside
    for s in same:
        condition = condition & s
    return points.join(F.broadcast(boxes), condition, how)


def nearest(left: DataFrame, right: DataFrame, on: str, id_col: str, distance: Column, limit: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """For each left row the nearest right row of the same text within the limit; `ties` are sort columns among equally near ones."""
    joined = left.join(right, on).withColumn("distance", distance)
    return joined.where(F.col("distance") <= limit).withColumn("__p", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", *ties))).where("__p = 1").drop("__p")


def first_by_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each distinct content, by its SHA-256."""
    place = F.row_number().over(Window.partitionBy("sha").orderBy(order))
    return rows.withColumn("sha", F.sha2(content, 256)).withColumn("place", place).where("place = 1").drop("place")


def split_of(patient: Column, last_calibration: int) -> Column:
    return F.when(patient <= last_calibration, "calib").otherwise("test")


def lines_of(points: DataFrame, key: str, gap: float = 6.0) -> DataFrame:
    """Characters (x, y, c) of each key as text: clusters by the running mean of y, then by x."""
    ordered = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "c"))).alias("pts"))
    folded = F.expr(
        f"""aggregate(pts, cast(array() as array<struct<m:double,n:int,cs:array<struct<x:double,c:string>>>>), (acc, p) ->
        if(size(acc) > 0 and abs(p.y - element_at(acc, -1).m) < {gap},
           concat(slice(acc, 1, size(acc) - 1), array(struct((element_at(acc, -1).m * element_at(acc, -1).n + p.y) / (element_at(acc, -1).n + 1) as m, element_at(acc, -1).n + 1 as n, array_append(element_at(acc, -1).cs, struct(cast(p.x as double) as x, p.c as c)) as cs))),
           concat(acc, array(struct(cast(p.y as double) as m, 1 as n, array(struct(cast(p.x as double) as x, p.c as c)) as cs)))))"""
    )
    return ordered.select(key, F.array_join(F.transform(folded, lambda line: F.array_join(F.transform(F.array_sort(line["cs"]), lambda c: c["c"]), "")), " ").alias("text"))


def bounds_of(points: DataFrame, key: str) -> DataFrame:
    """The bounding box of each key's points, to one place (ties to even)."""
    side = lambda f, c: F.bround(f(c), 1)
    return points.groupBy(key).agg(side(F.min, "x").alias("x0"), side(F.min, "y").alias("y0"), side(F.max, "x").alias("x1"), side(F.max, "y").alias("y1"))


def affine(pairs: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c, d, e, f) with rx = a x + b y + c and ry = d x + e y + f by least squares over each key's pairs (x, y, rx, ry).

    One aggregation of centred second moments; null where the points lie on a line.
    """
    cov = lambda p, q: F.covar_pop(p, q)
    sums = pairs.groupBy(key).agg(
        *(F.avg(c).alias(f"m_{c}") for c in ("x", "y", "rx", "ry")), cov("x", "x").alias("xx"), cov("x", "y").alias("xy"), cov("y", "y").alias("yy"),
        *(cov(p, q).alias(f"{p}_{q}") for p in ("x", "y") for q in ("rx", "ry")),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    good = det > 1e-9 * F.greatest(F.lit(1e-9), F.col("xx") * F.col("yy"))
    out = sums
    for first, second, last, target in (("a", "b", "c", "rx"), ("d", "e", "f", "ry")):
        px, py = F.col(f"x_{target}"), F.col(f"y_{target}")
        out = out.withColumns({first: F.when(good, (px * F.col("yy") - py * F.col("xy")) / det), second: F.when(good, (py * F.col("xx") - px * F.col("xy")) / det)})
        out = out.withColumn(last, F.col(f"m_{target}") - F.col(first) * F.col("m_x") - F.col(second) * F.col("m_y"))
    return out.select(key, "a", "b", "c", "d", "e", "f")


# Levels of degradation, and the base and step of the seeds.
LEVELS = ["clean", "mild", "medium", "severe"]
SEED_STEP = 1000


def capture_items(pages: DataFrame, page: str, levels: list[str] | None = None) -> DataFrame:
    """Each page once for every level, with a seed of its own."""
    names = F.array(*(F.lit(x) for x in levels or LEVELS))
    out = pages.select("*", F.posexplode(names).alias("k", "level"))
    return out.withColumn("seed", F.col(page) * SEED_STEP + F.col("k")).drop("k")


def with_images(pages: DataFrame, images: DataFrame, key: str, name: str) -> DataFrame:
    """Pages with the sorted names of their images, an empty array without any."""
    listed = images.groupBy(key).agg(F.sort_array(F.collect_list(name)).alias("images"))
    return pages.join(listed, key, "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def translated(rows: DataFrame, dictionary: DataFrame, text: str, language: str) -> DataFrame:
    """Rows with `surface`: the form of their text in their language by a dictionary (source, language, surface), or the text itself."""
    forms = dictionary.select(F.col("source").alias(text), F.col("language").alias(language), "surface")
    return rows.join(F.broadcast(forms) if dictionary.count() <= 100_000 else forms, [text, language], "left").withColumn("surface", F.coalesce("surface", F.col(text)))

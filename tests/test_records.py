"""Operators over small hand-made rows, against plain versions."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import confidence, datasets, evaluation, features, linking, metrics, privacy, stores
from tallyweave.sources import io
from tallyweave.streaming import lifecycle


def plain_fold(value):
    digits = {ord(c): str(k % 10) for k, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")}
    out = "".join(c for c in unicodedata.normalize("NFKD", value.translate(digits)) if not unicodedata.combining(c)).lower()
    out = re.sub("[\u0640\u064b-\u065f]", "", out.replace("œ", "oe").replace("’", "'"))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s/+.,'-]", " ", out)).strip(" .,:;")


def test_fold(spark):
    values = ["Céphalique", "CEPHALIQUE", "10٫5", "5٪ ٬ ٭ x", "١٢/٨", "cœur Œuf l’été", "ﬁn ½ … ²", "محمـّد ٱلله", "a\u00a0b\u2003c\x1cd", " .,x;: ", "Ångström Ǆ ﷺ", "", "İstanbul ẞ", "x_y-z+1/2"]
    # Characters that both Unicode tables, Python's and the JVM's, know.
    values += ["".join(chr(c) for c in range(k, k + 40) if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn") for k in range(0x20, 0x3000, 40)]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v string").select("id", text.fold(F.col("v")).alias("f")).collect()
    got = {r["id"]: r["f"] for r in rows}
    assert got[2] == "10 5" and got[0] == got[1] == "cephalique"
    wrong = [(values[k], got[k], plain_fold(values[k])) for k in range(len(values)) if got[k] != plain_fold(values[k])]
    assert not wrong, wrong[:3]
    assert all(text.fold_key(v) == plain_fold(v) for v in values)


def test_token_swaps(spark):
    rows = [(1, [("12", -0.1, [("17", -0.4), (" ", -0.2), ("12", -9.0)]), ("/8", -0.5, [("/3", -0.6), ("/6", -2.0)])]), (2, []), (3, [("a", 0.0, [])])]
    got = spark.createDataFrame(rows, "id int, t array<struct<token:string,logprob:double,others:array<struct<token:string,logprob:double>>>>").select("id", features.token_swaps(F.col("t")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {1: ["12/3", "17/8", "12/6"], 2: [], 3: []}


def test_missing_glyphs(spark):
    rows = [("vin gate", "vin�gate", "Vinégate", True), ("a", "a.�c", "a.yc", True), ("a", "a.�c", "abxyc", False), ("x", "x", None, False)]
    df = spark.createDataFrame(rows, "t string, raw string, p string, want boolean")
    got = df.select("want", evaluation.values_match(F.col("t"), F.col("raw"), F.col("p"), F.lit("text"), text.fold).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_candidates_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    make = lambda n, base: [(base + k, None if rng.random() < 0.3 else f"2026{rng.integers(40):04d}", int(rng.integers(15, 45)) if rng.random() < 0.9 else None, *(f"2025-{rng.integers(1, 13):02d}-{rng.integers(1, 28):02d}" if rng.random() < 0.7 else None for _ in range(2)), *(int(rng.integers(5)) if rng.random() < 0.9 else None for _ in range(2)), f"p{rng.integers(4)}") for k in range(n)]
    schema = "id int, code string, age int, lmp string, edd string, gravidity int, parity int, province string"
    frames = [spark.createDataFrame(make(n, b), schema).withColumns({c: F.col(c).cast("date") for c in ("lmp", "edd")}) for n, b in ((25, 0), (120, 1000))]
    q, p = frames[0].withColumnRenamed("id", "query_id"), frames[1].withColumnRenamed("id", "patient_id")
    blocked = {(r["query_id"], r["patient_id"], r["score"]) for r in linking.candidates(q, p, k=1000).collect()}
    whole = linking.candidate_pairs
    linking.candidate_pairs = lambda a, b: a.select("query_id", F.col("code").alias("c")).crossJoin(b.select("patient_id", F.col("code").alias("d"))).select("query_id", "patient_id", F.levenshtein("c", "d").alias("distance"))
    try:
        every = {(r["query_id"], r["patient_id"], r["score"]) for r in linking.candidates(q, p, k=1000).collect()}
    finally:
        linking.candidate_pairs = whole
    assert blocked == every and len(every) > 50 and all(0 <= s <= 1 for _, _, s in every)


def test_guarded_stream(spark, tmp_path):
    table = {"A": ["B"], "B": ["C"]}
    batches = [[("r", 1, "A"), ("r", 3, "B"), ("s", 1, "C")], [("r", 3, "B"), ("r", 2, "B"), ("r", 4, "A"), ("s", 2, "C")], [("r", 5, "C"), ("r", 2, "B")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "record_id string, event_id bigint, to_state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("record_id string, event_id bigint, to_state string").parquet(f"{tmp_path}/in")
        lifecycle.appended(lifecycle.guarded(stream, table), f"{tmp_path}/out", f"g{k}", f"{tmp_path}/ck").awaitTermination()
    got = {(r["record_id"], r["event_id"]): (r["from_state"], r["ok"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("r", 1): (None, True, None), ("r", 3): ("A", True, None), ("r", 2): ("B", False, "late"), ("r", 4): ("B", False, "illegal"), ("r", 5): ("B", True, None), ("s", 1): (None, True, None), ("s", 2): ("C", True, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("x.json", '{"v": 1}'), ("y.json", '{"v": 2}'), ("z.json", '{"v": 1}')):
        (tmp_path / "a" / name).write_text(body)
    folder = f"file://{tmp_path}/a"
    assert sorted(r["name"] for r in io.first_files(io.files(spark, folder)).collect()) == ["x.json", "y.json"]
    assert sorted((r["id"], r["v"]) for r in io.predictions(spark, folder, "v int").collect()) == [("x", 1), ("y", 2), ("z", 1)]
    io.save_weights(spark, f"{tmp_path}/w", ["a", "b"], [1, 2], 0.5)
    assert io.load_weights(spark, f"{tmp_path}/w", ["a", "b"]) == ([1.0, 2.0], 0.5)
    with pytest.raises(ValueError):
        io.load_weights(spark, f"{tmp_path}/w", ["b", "a"])
    asked = spark.createDataFrame([("m", "p1"), ("m", "p2"), ("m", "p2")], "model string, prompt string").withColumn("key", io.cache_key("model", "prompt"))
    cache = asked.where("prompt = 'p1'").select("key", F.lit("yes").alias("answer"))
    assert io.not_cached(asked, cache).count() == 1 and io.from_cache(asked, cache).where("answer = 'yes'").count() == 1
    assert io.between_markers("a<!-- t:begin -->old<!-- t:end -->b", "t", io.markdown(spark.createDataFrame([(1, None)], "x int, y string"))).split("\n")[1:4] == ["| x | y |", "| - | - |", "| 1 |  |"]
    io.append_run(spark, f"{tmp_path}/runs", "abc", True, ["m"])
    assert spark.read.json(f"{tmp_path}/runs").first()["dirty"] is True
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert io.append_missing(rows, f"{tmp_path}/sink", "id") == 2 and io.append_missing(rows, f"{tmp_path}/sink", "id") == 0
    (tmp_path / "c.csv").write_text("h one,k\n1,\n,2\n")
    assert [tuple(r) for r in io.csv(spark, f"{tmp_path}/c.csv").collect()] == [("1", None), (None, "2")]
    assert io.with_predictions(rows, rows.where("id = 1")).count() == 1


def test_fit_and_bootstrap(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * 2 - x[:, 1] + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, ok boolean")
    model = confidence.fit(rows, ["a", "b"], "ok")
    weights = model["weights"]
    weights = [weights[n] for n in ("a", "b")] if isinstance(weights, dict) else list(weights)
    assert weights[0] > 1 > 0 > weights[1]
    outcomes = spark.createDataFrame([(k // 10, k % 7 == 0, True) for k in range(200)], "page int, wrong boolean, among boolean")
    low, high = metrics.bootstrap(metrics.cluster_sums(outcomes, "page", F.col("wrong"), F.col("among")), "page", draws=500)
    assert low < 29 / 200 < high and metrics.bootstrap(metrics.cluster_sums(outcomes.where("page = 0"), "page", F.col("wrong"), F.col("among")), "page") is None


def test_labels_lines_and_boxes(spark):
    left = spark.createDataFrame([(1, "t", 0.0), (2, "t", 9.0)], "id int, text string, x double")
    right = spark.createDataFrame([("t", 1.0, "b"), ("t", -1.0, "a"), ("t", 30.0, "c")], "text string, rx double, name string")
    got = datasets.nearest(left, right, "text", "id", F.abs(F.col("x") - F.col("rx")), 20.0, ("name",)).collect()
    assert {r["id"]: r["name"] for r in got} == {1: "a", 2: "b"}
    points = spark.createDataFrame([("k", 2.0, 0.0, "b"), ("k", 1.0, 1.0, "a"), ("k", 1.0, 20.0, "c")], "k string, x double, y double, c string")
    assert datasets.lines_of(points, "k").first()["text"] == "ab c"
    labels = spark.createDataFrame([(0.0, 90.0), (90.0, 100.0), (160.0, 400.0), (36.5, 37.0), (38.0, 45.0)], "lo double, hi double").select(privacy.bin_label(F.col("lo"), F.col("hi")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["<90", "90–100", "≥160", "36.5–37", "≥38"]


def test_outbox_states(spark):
    outbox = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, None)], "job int, page_id string")
    pages = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "page_id string, record_id string")
    records = spark.createDataFrame([("r1", "SYNCED"), ("r2", "CAPTURED")], "record_id string, state string")
    assert {r["job"]: r["skip"] for r in stores.with_state(outbox, pages, records, ["SYNCED"]).collect()} == {1: True, 2: False, 3: False}
    seen = stores.audit(spark.createDataFrame([("i1", True), ("i2", False)], "image_id string, ok boolean"), "u", F.lit("t"), F.col("ok"))
    assert seen.count() == 2

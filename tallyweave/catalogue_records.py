"""More queries over the driver's tables: linking, fields, evaluation runs, stores and published aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _M, _OUT, _TAU, _outcomes, _rounded, query
from .functions import text
from .operators import datasets, evaluation, features, fields, linking, metrics, privacy, records, stores
from .sources import io

# -- linking -----------------------------------------------------------------------------------------------------------

_PATIENT = """SELECT c_custkey AS patient_id, '2026' || lpad(CAST(c_custkey*7%10000 AS VARCHAR),4,'0') AS code, CASE WHEN c_custkey%13<>0 THEN 15+c_custkey%30 END AS age, DATE '2026-01-01' + CAST(c_custkey*37%300 AS INTEGER) AS edd,
DATE '2026-01-01' + CAST(c_custkey*37%300 - 280 + c_custkey%9 AS INTEGER) AS lmp, c_custkey%6 AS gravidity, c_custkey%4 AS parity, 'P'||c_nationkey AS province FROM customer"""
_QUERY = """SELECT s_suppkey AS query_id, CASE WHEN s_suppkey%11<>0 THEN '2026' || lpad(CAST(s_suppkey*7%10000 + s_suppkey%3 AS VARCHAR),4,'0') END AS code, 15+s_suppkey*3%30 AS age, DATE '2026-01-01' + CAST(s_suppkey*41%300 AS INTEGER) AS edd,
DATE '2026-01-01' + CAST(s_suppkey*41%300 - 280 AS INTEGER) AS lmp, s_suppkey%6 AS gravidity, s_suppkey%4 AS parity, 'p'||s_nationkey AS province FROM supplier"""
_CODE_POINTS = "CASE WHEN d=0 THEN 0.7 WHEN d=1 THEN 0.45 WHEN d=2 AND length(qcode)>=6 THEN 0.25 ELSE 0 END::DOUBLE"


def _days(start, n):
    return F.date_add(F.lit(start).cast("date"), n.cast("int"))


def _patients(spark, sf):
    k = F.col("c_custkey")
    due = k * 37 % 300
    return io.parquet(spark, sf, "customer").select(
        k.alias("patient_id"), F.concat(F.lit("2026"), F.lpad((k * 7 % 10000).cast("string"), 4, "0")).alias("code"), F.when(k % 13 != 0, 15 + k % 30).alias("age"), _days("2026-01-01", due).alias("edd"),
        _days("2026-01-01", due - 280 + k % 9).alias("lmp"), (k % 6).alias("gravidity"), (k % 4).alias("parity"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("province"),
    )


def _queries(spark, sf):
    k = F.col("s_suppkey")
    due = k * 41 % 300
    return io.parquet(spark, sf, "supplier").select(
        k.alias("query_id"), F.when(k % 11 != 0, F.concat(F.lit("2026"), F.lpad((k * 7 % 10000 + k % 3).cast("string"), 4, "0"))).alias("code"), (15 + k * 3 % 30).alias("age"), _days("2026-01-01", due).alias("edd"),
        _days("2026-01-01", due - 280).alias("lmp"), (k % 6).alias("gravidity"), (k % 4).alias("parity"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("province"),
    )


@query(f"""WITH p AS ({_PATIENT}), q AS ({_QUERY}),
x AS (SELECT query_id, patient_id, q.code AS qcode, levenshtein(q.code, p.code) AS d, abs(q.age-p.age) AS da, abs(q.edd-p.edd) AS de, abs(q.lmp-p.lmp) AS dl, q.gravidity AS qg, p.gravidity AS pg, q.parity AS qp, p.parity AS pp, lower(q.province)=lower(p.province) AS same, p.age AS pa, q.age AS qa FROM q, p),
s AS (SELECT *, round(greatest(0, least(1, {_CODE_POINTS} + coalesce(CASE WHEN da<=1 THEN 0.1 WHEN da>3 THEN -0.2 END,0)::DOUBLE + coalesce(CASE WHEN de<=14 THEN 0.12 ELSE -0.15 END,0)::DOUBLE + coalesce(CASE WHEN dl<=14 THEN 0.12 ELSE -0.15 END,0)::DOUBLE
 + CASE WHEN qg=pg THEN 0.04 WHEN qg<pg THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN qp=pp THEN 0.04 WHEN qp<pp THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN same THEN 0.04 ELSE 0 END::DOUBLE)), 9) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, patient_id) AS rank FROM s WHERE score >= 0.175)
SELECT query_id, rank, patient_id, round(score,3) AS score, round(score,3) >= 0.35 AS plausible,
concat_ws(';', CASE WHEN d=0 THEN 'same code' WHEN d=1 THEN 'code off by 1' WHEN d=2 THEN 'code off by 2' END, CASE WHEN da<=1 THEN 'same age' END, CASE WHEN de<=14 THEN 'edd agrees' END, CASE WHEN dl<=14 THEN 'lmp agrees' END) AS reasons,
concat_ws(';', CASE WHEN da>3 THEN 'age '||pa||' / '||qa END, CASE WHEN de>14 THEN 'edd differs' END, CASE WHEN dl>14 THEN 'lmp differs' END, CASE WHEN qg<pg THEN 'gravidity '||pg||' / '||qg END, CASE WHEN qp<pp THEN 'parity '||pp||' / '||qp END, CASE WHEN NOT same THEN 'province differs' END) AS conflicts
FROM r WHERE rank <= 2""")
def q57_link_all_attributes(spark, sf):
    found = linking.candidates(_queries(spark, sf), _patients(spark, sf))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "patient_id", "score", "plausible", F.concat_ws(";", "reasons").alias("reasons"), F.concat_ws(";", "conflicts").alias("conflicts"))


@query(f"""WITH p AS ({_PATIENT}), q AS ({_QUERY}), x AS (SELECT query_id, patient_id, q.code AS qcode, levenshtein(q.code, p.code) AS d FROM q, p), s AS (SELECT query_id, patient_id, {_CODE_POINTS} AS score FROM x WHERE d<=2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, patient_id) AS rank FROM s WHERE score >= 0.25), t AS (SELECT * FROM r WHERE rank<=5) SELECT query_id, rank, patient_id, score, count(*) OVER (PARTITION BY query_id) = 1 AS opens FROM t""")
def q58_lookup_by_code(spark, sf):
    found = linking.lookup(_queries(spark, sf).where("code is not null"), _patients(spark, sf))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "patient_id", "score", "opens")


@query("SELECT o_clerk AS code, o FROM (SELECT o_orderpriority||(o_orderkey%500) AS o_clerk, string_agg(DISTINCT CAST(o_custkey AS VARCHAR), ',' ORDER BY CAST(o_custkey AS VARCHAR)) AS o, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) WHERE n>1")
def q59_code_owners(spark, sf):
    o = io.parquet(spark, sf, "orders").select(F.concat("o_orderpriority", (F.col("o_orderkey") % 500).cast("string")).alias("code"), F.col("o_custkey").cast("string").alias("owner"))
    return linking.code_owners(o, "owner", "code").select("code", F.array_join("owners", ",").alias("o"))


# -- fields ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'part.'||p_partkey AS field_id, CASE WHEN p_partkey%10<>0 THEN p_size END AS ord, p_brand AS label, CASE WHEN p_partkey%2=0 THEN lower(replace(p_brand,'#',' ')) ELSE p_brand END AS canonical FROM part),
f AS (SELECT l_orderkey, l_linenumber, 'part.'||l_partkey AS field_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(ord, 1073741824), field_id, l_linenumber) AS place FROM f JOIN c USING (field_id))
SELECT l_orderkey, l_linenumber, field_id, place, label, canonical, true AS of_page FROM r""")
def q60_booklet_order(spark, sf):
    p = F.col("p_partkey")
    spec = io.parquet(spark, sf, "part").select(F.concat(F.lit("part."), p.cast("string")).alias("field_id"), F.when(p % 10 != 0, F.col("p_size")).alias("ord"), F.concat("p_brand", F.lit(" (kg) — note")).alias("label"), F.when(p % 2 == 0, "text").otherwise("code").alias("value_type"), F.col("p_brand").alias("value"))
    facts = io.parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("field_id"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*fields.booklet_order(F.col("ord"), F.col("field_id")), "l_linenumber"))
    return fields.with_catalogue(facts, spec).select("l_orderkey", "l_linenumber", "field_id", place.cast("bigint").alias("place"), fields.clean_label(F.col("label")).alias("label"), F.when(F.col("value_type") == "text", text.fold(F.col("value"))).otherwise(F.col("value")).alias("canonical"), fields.of_page(F.col("field_id"), F.lit("part")).alias("of_page"))


@query("""SELECT p_partkey, CASE p_partkey%8 WHEN 0 THEN CASE WHEN p_size%2=0 THEN 'Oui' ELSE 'Non' END WHEN 1 THEN strftime(DATE '2025-01-01' + CAST(p_size AS INTEGER), '%d/%m/%Y') WHEN 2 THEN 'Négatif' WHEN 3 THEN p_size||' SA' WHEN 4 THEN p_size||' g' WHEN 5 THEN p_name WHEN 6 THEN '(illisible)' ELSE p_size||'.5 kg' END AS shown FROM part""")
def q61_display_values(spark, sf):
    k, size = F.col("p_partkey") % 8, F.col("p_size")
    pick = lambda *xs: F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in xs)), (k + 1).cast("int"))
    number = F.concat(size.cast("string"), F.lit(".0"))
    value = pick(F.when(size % 2 == 0, "true").otherwise("false"), F.date_add(F.lit("2025-01-01").cast("date"), size).cast("string"), "negative", number, number, F.col("p_name"), "x", F.concat(size.cast("string"), F.lit(".5")))
    rows = io.parquet(spark, sf, "part").select("p_partkey", value.alias("value"), pick("bool", "date", "enum", "gest_age", "float", "text", "text", "float").alias("value_type"), pick("checkbox", *["text"] * 7).alias("kind"), F.when(k == 2, "test_result").alias("vocabulary"), F.when(k == 4, "g").when(k == 7, "kg").alias("unit"), F.when(k == 6, "ILLEGIBLE").otherwise("KNOWN").alias("status"))
    shown = fields.display_value(*(F.col(c) for c in ("value", "value_type", "kind", "vocabulary", "unit")))
    return rows.select("p_partkey", fields.display(F.col("status"), shown).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id%9=0 THEN '—' ELSE replace(printf('%.1f', (event_id%1000)/10.0), '.', ',') || ' %' END AS rate, strftime(make_timestamp(1700000000000000 + event_id*60000000), '%d/%m %H:%M') AS clock, CASE WHEN length(event_type)>4 THEN left(event_type, 3) || '…' ELSE event_type END AS short, false AS arabic FROM events""")
def q62_formats(spark, sf):
    rate = F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 1000 / 1000.0)
    return io.parquet(spark, sf, "events").select("event_id", fields.percent(rate).alias("rate"), fields.clock(F.lit(1_700_000_000) + F.col("event_id") * 60).alias("clock"), text.cut(F.col("event_type"), 4).alias("short"), fields.is_arabic(F.col("event_type")).alias("arabic"))


@query("""SELECT DISTINCT p.l_orderkey AS record, 'part.'||p_size AS field_id, CASE WHEN l_quantity>25 THEN 'KNOWN' WHEN p_size%2=0 THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS status, CASE WHEN l_quantity>25 THEN 'v' WHEN p_size%2=0 THEN 'false' END AS value, CASE WHEN l_quantity>25 THEN 'manual' ELSE 'manual_default' END AS source
FROM (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber=1 GROUP BY 1) p, (SELECT DISTINCT p_size FROM part WHERE p_size<=5)""")
def q63_manual_fill(spark, sf):
    catalogue = io.parquet(spark, sf, "part").where("p_size <= 5").select(F.concat(F.lit("part."), F.col("p_size").cast("string")).alias("field_id"), F.lit("part").alias("page_type"), F.when(F.col("p_size") % 2 == 0, "checkbox").otherwise("text").alias("kind")).distinct()
    pages = io.parquet(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("record")).agg(F.max("l_quantity").alias("q")).withColumn("page_type", F.lit("part"))
    entered = pages.where("q > 25").join(F.broadcast(catalogue), "page_type").select("record", "field_id", F.lit("KNOWN").alias("status"), F.lit("v").alias("value"))
    return fields.fill_page(catalogue, entered, pages.select("record", "page_type"))


# -- evaluation --------------------------------------------------------------------------------------------------------

_FULL = """, round(avg((doc_id%7=0)::INT) FILTER (WHERE handwritten),6) AS missed_as_blank_share, round(avg((NOT accepted)::INT),6) AS all_fields_review_share, count(*) FILTER (WHERE doc_id%5=0) AS n_dash, round(avg(correct::INT) FILTER (WHERE doc_id%5=0),6) AS dash_accuracy,
round(avg((NOT correct)::INT) FILTER (WHERE checkbox AND accepted),6) AS checkbox_silent_error_rate"""


@query(_OUT + f" SELECT {_M}{_FULL} FROM o")
def q64_summary_of_19(spark, sf):
    return _rounded(metrics.summarise(_outcomes(spark, sf).withColumns({"dash": F.col("doc_id") % 5 == 0, "missed": F.col("doc_id") % 7 == 0})))


_CUT = "count(*) FILTER (WHERE handwritten) AS n_handwritten, round(avg(correct::INT) FILTER (WHERE handwritten),6) AS accuracy, round(avg(accepted::INT) FILTER (WHERE handwritten),6) AS auto_accepted_share, round(avg((NOT correct)::INT) FILTER (WHERE handwritten AND accepted),6) AS silent_error_rate, round(avg(correct::INT),6) AS all_fields_accuracy"


@query(_OUT + f" SELECT 'lang' AS key, lang AS value, {_CUT} FROM o GROUP BY 2 UNION ALL SELECT 'source', source, {_CUT} FROM o GROUP BY 2 UNION ALL SELECT 'level', 'l'||(doc_id%4), {_CUT} FROM o GROUP BY 2 UNION ALL SELECT 'page_type', 'p'||(doc_id%6), {_CUT} FROM o GROUP BY 2 UNION ALL SELECT 'script', 's'||(doc_id%3), {_CUT} FROM o GROUP BY 2")
def q65_five_breakdowns(spark, sf):
    d = F.col("doc_id")
    name = lambda c, n: F.concat(F.lit(c), (d % n).cast("string"))
    rows = _outcomes(spark, sf).withColumns({"level": name("l", 4), "page_type": name("p", 6), "script": name("s", 3)})
    return _rounded(evaluation.breakdowns(rows, ["lang", "source", "level", "page_type", "script"]))


_TRUTH = """SELECT o_orderkey AS k, o_orderpriority AS page_type, CASE WHEN o_orderkey%5=0 THEN 'checkbox' ELSE 'text' END AS kind, CASE o_orderkey%4 WHEN 2 THEN 'NOT_PROVIDED' WHEN 3 THEN 'NOT_APPLICABLE' ELSE 'KNOWN' END AS gt_status,
CASE WHEN o_orderkey%5=0 THEN CASE WHEN o_orderkey%2=0 THEN 'true' ELSE 'false' END ELSE o_orderpriority END AS value FROM orders"""
_PRED = """SELECT o_orderkey AS k, CASE WHEN o_orderkey%7=0 THEN 'other' ELSE o_orderpriority END AS page_type, CASE WHEN o_orderkey%8=0 THEN 'NEEDS_REVIEW' WHEN o_orderkey%4=2 THEN 'NOT_PROVIDED' ELSE 'KNOWN' END AS status,
CASE WHEN o_orderkey%5=0 THEN CASE WHEN o_orderkey%4<2 THEN 'true' ELSE 'false' END WHEN o_orderkey%9=0 THEN 'zz' ELSE lower(o_orderpriority) END AS value, o_orderkey%100/100.0::DOUBLE AS confidence, o_orderkey%10=1 AS special FROM orders WHERE o_orderkey%3<>0"""


@query(f"""WITH t AS ({_TRUTH}), p AS ({_PRED}), j AS (SELECT t.k, t.kind, t.gt_status, t.value AS tv, p.value AS pv, coalesce(p.status,'MISSING') AS pred_status, coalesce(p.confidence,0.0) AS confidence, p.k IS NOT NULL AS present, coalesce(special,false) AS special FROM t LEFT JOIN p ON t.k=p.k AND t.page_type=p.page_type)
SELECT k AS field_id, pred_status, confidence, CASE WHEN kind='checkbox' THEN (coalesce(pv,'')='true') = (tv='true') WHEN gt_status='KNOWN' THEN pred_status IN ('KNOWN','NEEDS_REVIEW') AND coalesce(lower(pv)=lower(tv),false) WHEN gt_status='NOT_PROVIDED' THEN pred_status IN ('NOT_PROVIDED','NOT_APPLICABLE') ELSE gt_status=pred_status END AS correct,
present AND pred_status NOT IN ('NEEDS_REVIEW','ILLEGIBLE') AND NOT special AS accepted FROM j""")
def q66_outcomes(spark, sf):
    o, k = io.parquet(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "checkbox").otherwise("text")
    value = F.when(k % 5 == 0, F.when(k % 2 == 0, "true").otherwise("false")).otherwise(F.col("o_orderpriority"))
    truth = o.select(F.col("o_custkey").alias("item"), k.alias("field_id"), F.col("o_orderpriority").alias("page_type"), kind.alias("kind"), F.when(k % 4 == 2, "NOT_PROVIDED").when(k % 4 == 3, "NOT_APPLICABLE").otherwise("KNOWN").alias("gt_status"), value.alias("value"), value.alias("raw"), F.lit("text").alias("value_type"))
    said = F.when(k % 5 == 0, F.when(k % 4 < 2, "true").otherwise("false")).when(k % 9 == 0, "zz").otherwise(F.lower("o_orderpriority"))
    predictions = o.where(k % 3 != 0).select(
        F.col("o_custkey").alias("item"), k.alias("field_id"), F.when(k % 7 == 0, "other").otherwise(F.col("o_orderpriority")).alias("page_type"), F.when(k % 8 == 0, "NEEDS_REVIEW").when(k % 4 == 2, "NOT_PROVIDED").otherwise("KNOWN").alias("status"),
        said.alias("value"), (k % 100 / 100.0).alias("confidence"), F.lit("ocr").alias("source"), F.when(k % 10 == 1, F.array(F.lit("confirm_special"))).alias("flags"),
    )
    match = evaluation.values_match(F.col("t_value"), F.col("t_raw"), F.col("p_value"), F.col("value_type"), text.fold)
    return evaluation.outcomes(truth, predictions, match).select("field_id", "pred_status", "confidence", "correct", "accepted")


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders WHERE o_orderkey%2=0 GROUP BY 1,2), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) AS p FROM c) WHERE p=1) SELECT count(*) AS n, round(avg((coalesce(a.o_orderpriority,'false')=o.o_orderpriority)::INT),6) AS majority, round(avg((o_orderkey%3=0)::INT),6) AS pipeline FROM orders o LEFT JOIN a USING (o_custkey)")
def q67_baselines(spark, sf):
    o = io.parquet(spark, sf, "orders")
    answers = metrics.majority(o.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderpriority", "o_orderkey").select(F.col("o_custkey").alias("field_id"), F.col("o_orderpriority").alias("answer"))
    return _rounded(evaluation.baselines(o.select(F.col("o_custkey").alias("field_id"), F.col("o_orderpriority").alias("t_value"), (F.col("o_orderkey") % 3 == 0).alias("correct")), answers))


@query("SELECT l_returnflag AS level, count(*) AS n, round(avg((l_linenumber%4=1)::INT),6) AS retake_share, round(avg((l_quantity>20)::INT) FILTER (WHERE l_linenumber%4<>1),6) AS accuracy_accepted, round(avg((l_quantity>20)::INT) FILTER (WHERE l_linenumber%4=1),6) AS accuracy_rejected FROM lineitem GROUP BY 1")
def q68_quality_gate_accuracy(spark, sf):
    n = F.col("l_linenumber") % 4
    rows = io.parquet(spark, sf, "lineitem").select(F.col("l_returnflag").alias("level"), F.when(n != 0, n != 1).alias("ok"), (F.col("l_quantity") > 20).alias("correct"))
    return _rounded(evaluation.gate(rows, "level", "ok"))


@query("WITH g AS (SELECT o_orderpriority AS patient, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM g) SELECT patient, round((t.s-g.s)/(t.n-g.n),4) AS held_out_mean, CAST(t.n-g.n AS BIGINT) AS n FROM g, t")
def q69_leave_one_out(spark, sf):
    o = io.parquet(spark, sf, "orders").select(F.col("o_orderpriority").alias("patient"), "o_totalprice")
    sizes = evaluation.folds(o, "patient").groupBy(F.col("fold").alias("patient")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.held_out_sums(o, "patient", "o_totalprice").join(sizes, "patient").select("patient", F.round("held_out_mean", 4).alias("held_out_mean"), "n")


@query(_OUT + f", e AS (SELECT tau, coalesce(avg((NOT correct)::INT) FILTER (WHERE confidence>=tau),0) AS err FROM o, {_TAU} GROUP BY 1) SELECT coalesce(min(tau) FILTER (WHERE err<=0.02), 0.99) AS tau, count(*) FILTER (WHERE err<=0.02) > 0 AS target_reached FROM e")
def q70_calibrate(spark, sf):
    return evaluation.calibrate(_outcomes(spark, sf), 0.02)


@query("""SELECT event_id, CASE WHEN event_id%5=0 THEN 0 ELSE round(-value*0.0075,6) END AS mean, CASE WHEN event_id%5=0 THEN 0 ELSE greatest(round(-value*0.01,4), -10) END AS least, CASE WHEN event_id%5=0 THEN 1 ELSE round(exp(-value*0.015),6) END AS prob, CASE WHEN event_id%3=0 THEN 1 ELSE 2 END AS n_flags,
CASE WHEN event_id%2=0 THEN 1.0 ELSE 0.0 END AS vt_date, CASE WHEN event_id%2=0 THEN 0.0 ELSE 1.0 END AS vt_number, round(least(value,200)/100,4) AS ink_cols, 0.0 AS second_agree, 18 AS n FROM events""")
def q71_reading_features(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    probs = F.when(e % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(-v * 0.01, -v * 0.005))
    kind = F.when(e % 2 == 0, "date").otherwise("float")
    stats = features.token_statistics(F.col("lp"))
    made = features.text_features(F.col("lp"), F.col("kind"), F.col("value"), F.lit(0.5), F.lit(None).cast("double"), {"parse_ok": F.lit(1.0)})
    flags = F.when(e % 3 == 0, F.array(F.lit("repaired"), F.lit("not_applicable:x"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = io.parquet(spark, sf, "events").select("event_id", "value", probs.alias("lp"), kind.alias("kind"), flags.alias("flags")).withColumn("f", made)
    vector = features.feature_vector(F.col("f"))
    at = lambda name: vector[features.FEATURES.index(name)].alias(name)
    return rows.select(
        "event_id", F.round(stats["mean_logprob"], 6).alias("mean"), at("lp_min").alias("least"), F.round(stats["seq_prob"], 6).alias("prob"), features.counted_flags(F.col("flags")).alias("n_flags"), at("vt_date"), at("vt_number"), at("ink_cols"), at("second_agree"), F.size(vector).alias("n"),
    )


@query("SELECT p_partkey, CASE WHEN p_size%2=0 THEN p_brand||',' ELSE '' END || 'a,b' || CASE WHEN p_size%2=0 THEN '' ELSE ',a' END AS alternatives, 'b' AS offered FROM part")
def q72_alternatives(spark, sf):
    given = F.array(F.lit("a"), F.lit("<|end|>"), F.lit("b"), F.lit("a"))
    second = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))
    return io.parquet(spark, sf, "part").select("p_partkey", F.array_join(features.with_second(F.lit("x"), second, given), ",").alias("alternatives"), F.array_join(features.offered(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("b")), F.lit("a")), ",").alias("offered"))


# -- published aggregates ----------------------------------------------------------------------------------------------

_KINDS = ["visit.bp", "newborn.temperature", "mother.temperature", "lab.hiv", "lab.syphilis"]
_FIELDS = """SELECT o_custkey AS w, o_orderkey%5 AS kind, o_orderkey AS k, o_orderkey%9<>0 AS known FROM orders"""
_WOMEN = f"""WITH f AS ({_FIELDS}), women AS (SELECT DISTINCT w FROM f), m AS (SELECT w, avg(85+k%80) FILTER (WHERE kind=0) AS systolic, avg(50+k%45) FILTER (WHERE kind=0) AS diastolic, avg(35.5+k%30/10.0::DOUBLE) FILTER (WHERE kind=2) AS temperature,
max(CASE WHEN k%7=0 THEN 2 WHEN k%7<5 THEN 1 ELSE 0 END) FILTER (WHERE kind=3) AS hiv, max(CASE WHEN k%7=0 THEN 2 WHEN k%7<5 THEN 1 ELSE 0 END) FILTER (WHERE kind=4) AS syphilis FROM f WHERE known GROUP BY 1), x AS (SELECT * FROM women LEFT JOIN m USING (w))"""


def _readings(spark, sf):
    k = F.col("o_orderkey")
    pressure = F.concat((85 + k % 80).cast("string"), F.lit("/"), (50 + k % 45).cast("string"))
    warm, result = (35.5 + k % 30 / 10.0).cast("string"), F.when(k % 7 == 0, "positive").when(k % 7 < 5, "negative").otherwise("not_done")
    at = (k % 5 + 1).cast("int")
    return io.parquet(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), F.element_at(F.array(*map(F.lit, _KINDS)), at).alias("field_id"), F.when(k % 9 != 0, "KNOWN").otherwise("ILLEGIBLE").alias("status"), F.element_at(F.array(pressure, warm, warm, result, result), at).alias("value"))


@query(_WOMEN + " SELECT w AS patient_id, round(systolic,4) AS systolic, round(diastolic,4) AS diastolic, round(temperature,4) AS temperature, CASE hiv WHEN 2 THEN 'positive' WHEN 1 THEN 'negative' WHEN 0 THEN 'not_done' END AS hiv, CASE syphilis WHEN 2 THEN 'positive' WHEN 1 THEN 'negative' WHEN 0 THEN 'not_done' END AS syphilis, CAST(NULL AS VARCHAR) AS hbsag FROM x")
def q73_women_indicators(spark, sf):
    return privacy.indicators(_readings(spark, sf)).select("patient_id", *(F.round(c, 4).alias(c) for c in privacy.BINS), *privacy.TESTS)


_SYS = "(SELECT * FROM (VALUES (0,0,90,'<90'),(1,90,100,'90–100'),(2,100,110,'100–110'),(3,110,120,'110–120'),(4,120,130,'120–130'),(5,130,140,'130–140'),(6,140,160,'140–160'),(7,160,400,'≥160')) v(bin,lo,hi,label))"


@query(_WOMEN + f", c AS (SELECT bin, label, count(systolic) AS n FROM {_SYS} b LEFT JOIN x ON systolic>=lo AND (systolic<hi OR (bin=7 AND systolic<=hi)) GROUP BY 1,2) SELECT bin, label, CASE WHEN n BETWEEN 1 AND 4 THEN NULL ELSE n END AS n FROM c")
def q74_published_systolic(spark, sf):
    return privacy.registered(_readings(spark, sf))["systolic"]


@query(_WOMEN + ", t AS (SELECT 'hiv' AS test, hiv AS r FROM x UNION ALL SELECT 'syphilis', syphilis FROM x), c AS (SELECT test, count(*) FILTER (WHERE r=2) AS p, count(*) FILTER (WHERE r=1) AS g, count(*) FILTER (WHERE r=0) AS o FROM t WHERE r IS NOT NULL GROUP BY 1) SELECT test, CASE WHEN p NOT BETWEEN 1 AND 4 THEN p END AS positive, CASE WHEN g NOT BETWEEN 1 AND 4 THEN g END AS negative, CASE WHEN o NOT BETWEEN 1 AND 4 THEN o END AS not_done, CASE WHEN p NOT BETWEEN 1 AND 4 AND g NOT BETWEEN 1 AND 4 AND o NOT BETWEEN 1 AND 4 AND p+g+o NOT BETWEEN 1 AND 4 THEN p+g+o END AS tested FROM c")
def q75_published_tests(spark, sf):
    return privacy.registered(_readings(spark, sf))["tests"]


@query("SELECT count(*) FILTER (WHERE l_linenumber=1) AS positive, count(*) FILTER (WHERE l_linenumber=0) AS negative, count(*) FILTER (WHERE l_linenumber>1) AS not_done FROM lineitem")
def q76_coded_results(spark, sf):
    return privacy.code_counts(io.parquet(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("string")).alias("c")), "c")


# -- records -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey%4<>0 AND o_orderstatus<>'P' AND o_orderkey%10<>0 AS changed, CASE WHEN o_orderkey%4=0 THEN 'manual' WHEN o_orderstatus<>'P' AND o_orderkey%10<>0 THEN 'confirmed' ELSE 'ocr' END AS source FROM orders")
def q77_confirm_all(spark, sf):
    k = F.col("o_orderkey")
    rows = io.parquet(spark, sf, "orders").select("o_orderkey", F.when(k % 4 == 0, "manual").otherwise("ocr").alias("source"), F.when(F.col("o_orderstatus") == "P", "NEEDS_REVIEW").otherwise("KNOWN").alias("status"), (k % 10 == 0).alias("confirm_special"))
    return records.confirm_all(rows).select("o_orderkey", "changed", "source")


@query("SELECT o_orderkey, 'KNOWN' AS status, 'new' AS value, 1.0 AS confidence, 'u'||o_custkey AS decided_by, 2 AS n_audit, o_orderpriority||'>new' AS last FROM orders")
def q78_decide(spark, sf):
    step = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("u0").alias("by"), F.lit("a").alias("from"), F.lit("b").alias("to"))
    entry = F.struct(F.lit("NEEDS_REVIEW").alias("status"), F.col("o_orderpriority").alias("value"), F.lit("ocr").alias("source"), F.lit(0.4).alias("confidence"), F.array(step).alias("audit"))
    who = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    rows = io.parquet(spark, sf, "orders").select("o_orderkey", records.decide(entry, F.lit("KNOWN"), F.lit("new"), F.lit("corrected"), who, F.col("o_orderkey")).alias("e"))
    last = F.element_at("e.audit", -1)
    return rows.select("o_orderkey", "e.status", "e.value", "e.confidence", "e.decided_by", F.size("e.audit").alias("n_audit"), F.concat(last["from"], F.lit(">"), last["to"]).alias("last"))


@query("SELECT l_orderkey AS record_id, coalesce(max(CASE WHEN l_orderkey%3=0 THEN 'typed' END), max(CASE WHEN l_linenumber=1 AND l_linestatus='F' THEN l_partkey::VARCHAR END)) AS code, max(CASE WHEN l_linenumber=2 AND l_linestatus='F' THEN l_partkey::VARCHAR END) AS age, max(CASE WHEN l_linenumber=3 AND l_linestatus='F' THEN l_partkey::VARCHAR END) AS province FROM lineitem GROUP BY 1")
def q79_quasi_identifiers(spark, sf):
    n = F.col("l_linenumber")
    field = F.when(n == 1, "cover.registry_code").when(n == 2, "history.age").when(n == 3, "cover.province").otherwise("x.y")
    rows = io.parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.when(F.col("l_orderkey") % 3 == 0, "typed").alias("code"), field.alias("field_id"), F.when(F.col("l_linestatus") == "F", "NEEDS_REVIEW").otherwise("ILLEGIBLE").alias("status"), F.col("l_partkey").cast("string").alias("value"))
    return records.quasi_identifiers(rows).select("record_id", "code", "age", "province")


@query("SELECT l_orderkey, l_linenumber, CASE l_orderkey%3 WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus ELSE CASE WHEN l_linenumber%2=0 THEN l_linestatus ELSE l_returnflag END END AS value FROM lineitem")
def q80_redigitised(spark, sf):
    choice = F.element_at(F.array(F.lit("keep_old"), F.lit("take_new"), F.lit("one_by_one")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return io.parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", records.resolve(F.col("l_returnflag"), F.col("l_linestatus"), choice, F.when(F.col("l_linenumber") % 2 == 0, "new").otherwise("old")).alias("value"))


@query("SELECT DISTINCT l_orderkey AS k, l_returnflag AS page_type FROM lineitem WHERE l_linenumber=1 INTERSECT SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber=2")
def q81_pages_in_profile(spark, sf):
    li = io.parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat("l_returnflag", F.lit(".f")).alias("field_id"), "l_linenumber")
    return records.pages_in_profile(li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), "k")


@query("SELECT o_custkey AS patient, o_orderpriority AS name, string_agg(strftime(o_orderdate, '%d/%m/%Y')||': '||o_orderkey, '; ' ORDER BY o_orderdate, strftime(o_orderdate, '%d/%m/%Y')||': '||o_orderkey) AS line FROM orders GROUP BY 1,2")
def q82_profile_summary(spark, sf):
    o = io.parquet(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("name"), "o_orderdate", F.col("o_orderkey").cast("string").alias("shown"))
    return records.summary(o, "patient", "o_orderdate", "name", "shown")


@query("SELECT count(*)*3 AS n_fields, count(*)*2 + count(*) FILTER (WHERE l_returnflag<>'N') AS n_filled, count(*) FILTER (WHERE l_linenumber=1) AS n_stray, count(*) FILTER (WHERE l_linestatus='F') AS n_dropped FROM lineitem")
def q83_dataset_totals(spark, sf):
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = io.parquet(spark, sf, "lineitem").select(F.array(F.lit("a"), F.lit("b"), F.when(F.col("l_returnflag") != "N", "c").otherwise("")).alias("fields"), some(F.col("l_linenumber") == 1).alias("unassigned"), some(F.col("l_linestatus") == "F").alias("dropped"))
    return records.totals(rows)


# -- stores ------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, CASE event_id%3 WHEN 0 THEN 'sync' ELSE 'process' END AS kind, event_id%12 AS a, CASE event_id%4 WHEN 0 THEN 'offline' WHEN 1 THEN 'server' ELSE 'unavailable' END AS error FROM events)
SELECT event_id, CASE WHEN error='offline' THEN a ELSE a+1 END AS attempts, CASE WHEN error='offline' THEN 0.0 ELSE least(600.0, pow(2.0, a+1)) END AS wait, kind<>'sync' AND error<>'offline' AND a+1 >= CASE error WHEN 'server' THEN 4 ELSE 10 END AS failed FROM e""")
def q84_retry_policy(spark, sf):
    e = F.col("event_id")
    kind, error = F.when(e % 3 == 0, "sync").otherwise("process"), F.when(e % 4 == 0, "offline").when(e % 4 == 1, "server").otherwise("unavailable")
    attempts, wait, failed = stores.retry(kind, e % 12, error)
    return io.parquet(spark, sf, "events").select("event_id", attempts.alias("attempts"), wait.alias("wait"), failed.alias("failed"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, user_id||':'||event_id AS retry_key FROM events WHERE event_type<>'purchase' AND value<=50")
def q85_due_jobs(spark, sf):
    outbox = io.parquet(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("done"), F.col("value").alias("next_attempt_at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return stores.due(outbox, F.lit(50.0)).select("user_id", "event_id", place.cast("bigint").alias("place"), stores.manual_key(F.col("user_id").cast("string"), F.col("event_id")).alias("retry_key"))


@query("WITH l AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS pages, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(pages,'') AS pages, coalesce(n,0) AS n_pages, 1 AS n_steps FROM orders LEFT JOIN l ON l_orderkey=o_orderkey")
def q86_snapshot(spark, sf):
    r = io.parquet(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    pages = io.parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = stores.snapshot(r.select("o_orderkey"), pages, r, "o_orderkey")
    return out.select("o_orderkey", F.coalesce(F.array_join(F.col("pages.l_linenumber").cast("array<string>"), ","), F.lit("")).alias("pages"), F.col("n_pages").cast("bigint").alias("n_pages"), "n_steps")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC) > 1 AS replaced FROM lineitem")
def q87_replaced_pages(spark, sf):
    return stores.replaced_pages(io.parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_returnflag", "l_linenumber").drop("l_returnflag")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) SELECT * FROM r WHERE place<=12")
def q88_latest_of_user(spark, sf):
    return stores.newest_of_each(io.parquet(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 12).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 200")
def q89_audit_view(spark, sf):
    return stores.newest(io.parquet(spark, sf, "events").select("event_id", "value"), "event_id", 200)


@query("SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN c_custkey%10=3 WHEN 1 THEN c_nationkey=7 ELSE false END AS visible, true AS opened, true AS refused FROM customer")
def q90_access_and_sealing(spark, sf):
    k = F.col("c_custkey")
    role = F.element_at(F.array(F.lit("midwife"), F.lit("supervisor"), F.lit("epidemiologist")), (k % 3 + 1).cast("int"))
    key, name = F.lit("0123456789abcdef0123456789abcdef"), F.col("c_name")
    sealed = io.parquet(spark, sf, "customer").withColumn("sealed", stores.seal(name, key, k.cast("string")))
    opened = stores.unseal(F.col("sealed"), key, k.cast("string")) == name
    refused = stores.unseal(F.col("sealed"), key, F.lit("another")).isNull()
    return sealed.select("c_custkey", stores.visible(role, k % 10, F.lit(3), F.col("c_nationkey"), F.lit(7)).alias("visible"), F.coalesce(opened, F.lit(False)).alias("opened"), refused.alias("refused"))


# -- datasets ----------------------------------------------------------------------------------------------------------


@query("SELECT p_size, 2.0 AS a, 0.5 AS b, 3.0 AS c, -1.0 AS d, 1.5 AS e, 7.0 AS f FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 3")
def q91_affine(spark, sf):
    x, y = F.col("p_partkey").cast("double"), F.col("p_retailprice") / 10 + F.pow(F.col("p_partkey") % 17, 2)
    pairs = io.parquet(spark, sf, "part").select("p_size", x.alias("x"), y.alias("y")).select("p_size", "x", "y", (2 * F.col("x") + 0.5 * F.col("y") + 3).alias("rx"), (-F.col("x") + 1.5 * F.col("y") + 7).alias("ry"))
    many = pairs.groupBy("p_size").agg(F.count_distinct("x").alias("n")).where("n > 3").select("p_size")
    return datasets.affine(pairs.join(many, "p_size", "left_semi"), "p_size").select("p_size", *(F.round(c, 4).alias(c) for c in "abcdef"))


@query("SELECT p_brand, round_even(min(p_retailprice),1) AS x0, round_even(min(p_size),1)::DOUBLE AS y0, round_even(max(p_retailprice),1) AS x1, round_even(max(p_size),1)::DOUBLE AS y1 FROM part GROUP BY 1")
def q92_bounding_boxes(spark, sf):
    return datasets.bounds_of(io.parquet(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y")), "p_brand")


@query("SELECT c_custkey, level, c_custkey*1000+k AS seed FROM customer, (VALUES (0,'clean'),(1,'mild'),(2,'medium'),(3,'severe')) v(k,level)")
def q93_capture_items(spark, sf):
    return datasets.capture_items(io.parquet(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("WITH i AS (SELECT o_custkey, string_agg('img'||o_orderkey, ',' ORDER BY 'img'||o_orderkey) AS images FROM orders GROUP BY 1) SELECT c_custkey, coalesce(images,'') AS images, CASE WHEN c_mktsegment='BUILDING' THEN 'bâtiment' ELSE c_mktsegment END AS surface FROM customer LEFT JOIN i ON c_custkey=o_custkey")
def q94_images_and_surfaces(spark, sf):
    c = io.parquet(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit("fr").alias("language"))
    images = io.parquet(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("img"), F.col("o_orderkey").cast("string")).alias("name"))
    dictionary = spark.createDataFrame([("BUILDING", "fr", "bâtiment"), ("BUILDING", "en", "building")], "source string, language string, surface string")
    rows = datasets.translated(datasets.with_images(c, images, "c_custkey", "name"), dictionary, "c_mktsegment", "language")
    return rows.select("c_custkey", F.array_join("images", ",").alias("images"), "surface")

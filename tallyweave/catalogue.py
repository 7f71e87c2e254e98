"""All queries of the library over the driver's tables, by name, and their SQL. Whole tables, no limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import parse, text
from .operators import confidence, datasets, linking, metrics, page_rules, parsing, privacy, records, rules
from .sources import io
from .streaming import lifecycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


EDGES = [0, 60000, 120000, 180000, 240000, 300000, 1000000]
_BINS = "(SELECT * FROM (VALUES (0,0.0,60000.0),(1,60000.0,120000.0),(2,120000.0,180000.0),(3,180000.0,240000.0),(4,240000.0,300000.0),(5,300000.0,1000000.0)) t(bin,lo,hi))"
_HIST = f"WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY 1), h AS (SELECT bin, lo, hi, count(mean) AS c FROM {_BINS} b LEFT JOIN m ON mean >= lo AND (mean < hi OR (bin = 5 AND mean <= hi)) GROUP BY 1,2,3), s AS (SELECT bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE c END AS n FROM h)"


def _means(spark, sf):
    return privacy.entity_means(io.parquet(spark, sf, "orders"), "o_custkey", "o_totalprice")


@query(_HIST + " SELECT bin, lo, hi, n FROM s")
def q01_kanon_histogram(spark, sf):
    return privacy.histogram(_means(spark, sf), "mean", EDGES)


@query(_HIST + " SELECT CASE WHEN (SELECT bool_or(n IS NULL) FROM s) THEN NULL ELSE count(mean) END AS n, round(CASE WHEN count(mean) >= 5 THEN avg(mean) END, 4) AS mean FROM m")
def q01b_kanon_total(spark, sf):
    people = _means(spark, sf)
    return privacy.total_of(privacy.histogram(people, "mean", EDGES), people, "mean").select("n", F.round("mean", 4).alias("mean"))


@query("""WITH c AS (SELECT o_custkey % 97 AS grp, count(*) FILTER (WHERE o_orderstatus='F') AS F, count(*) FILTER (WHERE o_orderstatus='O') AS O, count(*) FILTER (WHERE o_orderstatus='P') AS P FROM orders GROUP BY 1)
SELECT grp, CASE WHEN F BETWEEN 1 AND 4 THEN NULL ELSE F END AS F, CASE WHEN O BETWEEN 1 AND 4 THEN NULL ELSE O END AS O, CASE WHEN P BETWEEN 1 AND 4 THEN NULL ELSE P END AS P,
CASE WHEN F BETWEEN 1 AND 4 OR O BETWEEN 1 AND 4 OR P BETWEEN 1 AND 4 OR F+O+P BETWEEN 1 AND 4 THEN NULL ELSE F+O+P END AS tested FROM c""")
def q02_kanon_cell_counts(spark, sf):
    return privacy.cell_counts(io.parquet(spark, sf, "orders").withColumn("grp", F.col("o_custkey") % 97), "grp", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_custkey, CASE max(CASE WHEN o_orderstatus='P' THEN 2 WHEN o_orderstatus='F' THEN 1 ELSE 0 END) WHEN 2 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'not_done' END AS result FROM orders GROUP BY 1")
def q03_anyof_precedence(spark, sf):
    return privacy.any_of(io.parquet(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F")


def _outcomes(spark, sf):
    d, lab = io.parquet(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), io.parquet(spark, sf, "labels")
    return lab.join(d, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", ((F.col("doc_id") * 37) % 1000 / 1000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"), ((F.col("doc_id") * 37) % 1000 / 1000.0 >= 0.5).alias("accepted"),
        (F.col("toxic") == 0).alias("handwritten"), (F.col("toxic") == 1).alias("blank"), (F.col("doc_id") % 3 == 0).alias("checkbox"),
    )


_OUT = "WITH o AS (SELECT doc_id, lang, source, n_chars, ((doc_id*37)%1000)/1000.0::DOUBLE AS confidence, quality=1 AS correct, ((doc_id*37)%1000)/1000.0::DOUBLE >= 0.5 AS accepted, toxic=0 AS handwritten, toxic=1 AS blank, doc_id%3=0 AS checkbox FROM labels JOIN documents USING (doc_id))"
_M = """count(*) AS n_fields, round(avg(correct::INT),6) AS all_fields_accuracy, count(*) FILTER (WHERE handwritten) AS n_handwritten, round(avg(correct::INT) FILTER (WHERE handwritten),6) AS accuracy, round(avg(accepted::INT) FILTER (WHERE handwritten),6) AS auto_accepted_share,
round(avg(correct::INT) FILTER (WHERE handwritten AND accepted),6) AS accuracy_when_auto_accepted, round(avg((NOT accepted)::INT) FILTER (WHERE handwritten),6) AS flagged_for_review_share, round(avg((NOT correct)::INT) FILTER (WHERE handwritten AND accepted),6) AS silent_error_rate,
round(avg((NOT correct)::INT) FILTER (WHERE accepted),6) AS all_fields_silent_error_rate, count(*) FILTER (WHERE blank) AS n_blank, round(avg(correct::INT) FILTER (WHERE blank),6) AS blank_accuracy, count(*) FILTER (WHERE blank AND NOT correct) AS blank_errors, count(*) FILTER (WHERE checkbox) AS n_checkbox, round(avg(correct::INT) FILTER (WHERE checkbox),6) AS checkbox_accuracy"""


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(_OUT + f" SELECT {_M} FROM o")
def q04_metrics_summary(spark, sf):
    return _rounded(metrics.summarise(_outcomes(spark, sf)))


@query(_OUT + f" SELECT source, {_M} FROM o GROUP BY source")
def q05_metrics_breakdown(spark, sf):
    return _rounded(metrics.summarise(_outcomes(spark, sf), ["source"]))


_EDGE = "".join(f" + CASE WHEN confidence >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in metrics.ECE_EDGES[1:-1])
_ECE = _OUT + f", b AS (SELECT 0{_EDGE} AS bin, count(*) AS n, avg(correct::INT) AS accuracy, avg(confidence) AS confidence FROM o GROUP BY 1)"


@query(_ECE + " SELECT bin, n, round(accuracy,6) AS accuracy, round(confidence,6) AS confidence FROM b")
def q06_ece_bins(spark, sf):
    return _rounded(metrics.ece_bins(_outcomes(spark, sf)))


@query(_ECE + " SELECT round(sum(n*abs(accuracy-confidence))/sum(n),6) AS ece FROM b")
def q07_ece(spark, sf):
    return _rounded(metrics.ece(_outcomes(spark, sf)))


@query(_OUT + " SELECT round(avg((confidence-correct::INT)*(confidence-correct::INT)),4) AS brier FROM o")
def q08_brier(spark, sf):
    d = F.col("confidence") - F.col("correct").cast("double")
    return _outcomes(spark, sf).agg(F.round(F.avg(d * d), 4).alias("brier"))


@query(_OUT + ", r AS (SELECT correct, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1)/2.0 AS r FROM o) SELECT round((sum(r) FILTER (WHERE correct) - count(*) FILTER (WHERE correct)*(count(*) FILTER (WHERE correct)+1)/2.0)/(count(*) FILTER (WHERE correct)*count(*) FILTER (WHERE NOT correct)),6) AS auroc FROM r")
def q09_auroc(spark, sf):
    return _rounded(metrics.auroc(_outcomes(spark, sf)))


_TH = "(SELECT unnest([" + ",".join(f"{t!r}::DOUBLE" for t in metrics.THRESHOLDS) + "]) AS threshold)"


@query(_OUT + f" SELECT threshold, round(avg((confidence>=threshold)::INT),6) AS coverage, round(coalesce(avg((NOT correct)::INT) FILTER (WHERE confidence>=threshold),0),6) AS error FROM o, {_TH} GROUP BY 1")
def q10_risk_coverage(spark, sf):
    return metrics.risk_coverage(_outcomes(spark, sf)).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("error", 6).alias("error"))


_TAU = "(SELECT unnest([" + ",".join(f"{t!r}::DOUBLE" for t in metrics.TAU_GRID) + "]) AS tau)"


@query(_OUT + f", e AS (SELECT tau, coalesce(avg((NOT correct)::INT) FILTER (WHERE confidence>=tau),0) AS err FROM o, {_TAU} GROUP BY 1) SELECT min(tau) FILTER (WHERE err<=0.1) AS tau FROM e")
def q11_tau_search(spark, sf):
    return metrics.tau_search(_outcomes(spark, sf), 0.1)


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) AS p FROM c) SELECT o_custkey, o_orderpriority FROM k WHERE p=1")
def q12_majority_baseline(spark, sf):
    return metrics.majority(io.parquet(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(_OUT + " SELECT source, count(*) FILTER (WHERE handwritten AND accepted AND NOT correct) AS num, count(*) FILTER (WHERE handwritten AND accepted) AS den FROM o GROUP BY 1")
def q13_cluster_sums(spark, sf):
    return metrics.cluster_sums(_outcomes(spark, sf), "source", ~F.col("correct"), F.col("handwritten") & F.col("accepted"))


@query("SELECT l_orderkey, l_linenumber, round(1/(1+exp(-(0.3 + l_discount*2.0 + l_tax*0.8 - l_quantity/50.0*1.2))),6) AS score FROM lineitem")
def q14_logistic_score(spark, sf):
    features = {"lp_mean": F.col("l_discount"), "lp_min": F.col("l_tax"), "n_flags": F.col("l_quantity") / 50.0}
    score = confidence.logistic(features, {k: confidence.DEFAULT_WEIGHTS[k] for k in features}, confidence.INTERCEPT)
    return io.parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'NOT_APPLICABLE' ELSE 'KNOWN' END AS status, CASE WHEN o_orderkey%5=0 THEN 'checkbox' ELSE 'ocr' END AS source, ((o_orderkey*37)%1000)/1000.0::DOUBLE AS conf, o_orderkey%7<>0 AS parse_ok, o_orderkey%11=0 AS flagged, o_orderkey%13=0 AS several FROM orders)
SELECT o_orderkey, CASE WHEN source='checkbox' AND several THEN 'NEEDS_REVIEW' WHEN source<>'ocr' THEN status WHEN status='KNOWN' AND NOT parse_ok AND conf<0.15 THEN 'ILLEGIBLE' WHEN status='KNOWN' AND (conf<0.8 OR flagged) THEN 'NEEDS_REVIEW' ELSE status END AS status,
source='ocr' AND status IN ('UNKNOWN','NOT_APPLICABLE') AND conf<0.8 AS confirm_special FROM r""")
def q15_finalise_status(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 1, "UNKNOWN").when(k % 4 == 2, "NOT_APPLICABLE").otherwise("KNOWN")
    decided, special = confidence.finalise(status, F.when(k % 5 == 0, "checkbox").otherwise("ocr"), (k * 37) % 1000 / 1000.0, k % 7 != 0, F.when(k % 11 == 0, 1).otherwise(0), k % 13 == 0)
    return io.parquet(spark, sf, "orders").select("o_orderkey", decided.alias("status"), special.alias("confirm_special"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(replace(replace(replace(text,'œ','oe'),'Œ','oe'),'’',''''))), '[^\\p{L}\\p{N}_/+.,''-]+', ' ', 'g'), ' .,:;')) AS folded_sha256 FROM documents")
def q16_fold_text(spark, sf):
    """Folded source text by document, as a digest."""
    return io.parquet(spark, sf, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded_sha256"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(translate(regexp_replace(translate(regexp_replace(html,'<[^>]+>',' ','g'),'*`#|','    '),'\.{3,}|…+',' ','g'),'\','/'),'\s+',' ','g'),' "''“”:;')) AS clean_sha256 FROM pages""")
def q17_clean_markup(spark, sf):
    return io.parquet(spark, sf, "pages").select("page_id", F.sha2(text.clean_raw(F.col("html")), 256).alias("clean_sha256"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_replace(regexp_replace(text,'(?:\+?212|0)\s*[5-7](?:[\s.\-]*[0-9]){8}','[masqué]','g'),'\b[A-Z]{1,2}\s?[0-9]{5,7}\b','[masqué]','gi') AS t FROM documents) SELECT doc_id, t<>text AS changed, sha256(t) AS scrubbed_sha256 FROM s""")
def q18_pii_scrub(spark, sf):
    clean = text.scrub(F.col("text"))
    return io.parquet(spark, sf, "documents").select("doc_id", (clean != F.col("text")).alias("changed"), F.sha2(clean, 256).alias("scrubbed_sha256"))


_RAW = "CASE p_partkey%5 WHEN 0 THEN p_size||' kg' WHEN 1 THEN '1 2 '||p_size WHEN 2 THEN p_size||',5 g' WHEN 3 THEN p_size||'k' ELSE 'abc' END"


@query(f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part), t AS (SELECT p_partkey, raw, CASE WHEN regexp_full_match(raw,'[0-9\\s]+') THEN regexp_replace(raw,'\\s','','g') ELSE raw END AS t FROM r)
SELECT p_partkey, TRY_CAST(replace(nullif(regexp_extract(t,'([0-9]+(?:[.,][0-9]+)?)',1),''),',','.') AS DOUBLE) * CASE WHEN regexp_matches(t,'[0-9]\\s*[kK]\\b') THEN 1000.0 ELSE 1.0 END::DOUBLE AS value FROM t""")
def q19_parse_number(spark, sf):
    return io.parquet(spark, sf, "part").withColumn("raw", F.expr(_RAW)).select("p_partkey", parse.parse_number(F.col("raw")).alias("value"))


@query("""WITH r AS (SELECT p_partkey, CAST(CASE WHEN p_partkey%2=0 THEN 80+p_size*2 ELSE 8+p_size%12 END AS INT) AS s0, CAST(CASE WHEN p_partkey%2=0 THEN 40+p_size ELSE 5+p_size%9 END AS INT) AS d0 FROM part),
b AS (SELECT p_partkey, CASE WHEN s0<30 AND d0<20 THEN s0*10 ELSE s0 END AS sys, CASE WHEN s0<30 AND d0<20 THEN d0*10 ELSE d0 END AS dia FROM r) SELECT p_partkey, sys, dia, sys BETWEEN 70 AND 220 AND dia BETWEEN 40 AND 140 AND sys>dia AS plausible FROM b""")
def q20_parse_bp(spark, sf):
    raw = F.expr("concat(case when p_partkey%2=0 then 80+p_size*2 else 8+p_size%12 end, ' / ', case when p_partkey%2=0 then 40+p_size else 5+p_size%9 end)")
    bp = io.parquet(spark, sf, "part").withColumn("bp", parse.parse_bp(raw))
    return bp.select("p_partkey", F.col("bp.sys").alias("sys"), F.col("bp.dia").alias("dia"), parse.bp_plausible(F.col("bp.sys"), F.col("bp.dia")).alias("plausible"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%9=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def q21_parse_date(spark, sf):
    raw = F.when(F.col("o_orderkey") % 9 == 0, F.lit("31/02/2025")).otherwise(F.date_format("o_orderdate", "d / M-yyyy"))
    return io.parquet(spark, sf, "orders").select("o_orderkey", parse.parse_date(raw).alias("parsed"))


_VOC = "(SELECT * FROM (VALUES ('automobile','car'),('building','house'),('furniture','home'),('household','home'),('machinery','tool')) v(form,token))"


@query(f"SELECT c_custkey, token FROM customer LEFT JOIN {_VOC} ON lower(c_mktsegment)=form")
def q22_vocab_exact(spark, sf):
    forms = spark.createDataFrame([("automobile", "car"), ("building", "house"), ("furniture", "home"), ("household", "home"), ("machinery", "tool")], "form string, token string")
    return io.parquet(spark, sf, "customer").withColumn("form", F.lower("c_mktsegment")).join(F.broadcast(forms), "form", "left").select("c_custkey", "token")


_FORMS = ["economy", "standard", "promo", "large", "medium", "small"]


# The longest common subsequence by brute force: every choice of a form's letters as a LIKE pattern.
@query(f"""WITH f AS (SELECT * FROM (VALUES {",".join(f"({k},'{f}')" for k, f in enumerate(_FORMS))}) v(ord, form)), m AS (SELECT ord, form, list_filter(range(1, length(form)+1), lambda i: (mask >> (i-1)) % 2 = 1) AS idx FROM f, (SELECT unnest(range(0, 256)) AS mask) WHERE mask < (1 << length(form))),
w AS (SELECT ord, form, len(idx) AS n, '%' || array_to_string(list_transform(idx, lambda i: substring(form, CAST(i AS BIGINT), 1)), '%') || '%' AS pattern FROM m), q AS (SELECT DISTINCT translate(lower(split_part(p_type, ' ', 1)), 'aeo', 'o3a') AS probe FROM part),
r AS (SELECT probe, form, ord, round(2.0::DOUBLE * max(n) / (length(probe) + length(form)), 6) AS ratio FROM q JOIN w ON probe LIKE pattern GROUP BY probe, form, ord), k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY ratio DESC, ord) AS p FROM r) SELECT probe, form, ratio FROM k WHERE p=1""")
def q23_vocab_fuzzy(spark, sf):
    """Best vocabulary form of each distinct misread type by indel ratio (a closed list of forms)."""
    forms = spark.createDataFrame(list(enumerate(_FORMS)), "ord int, form string")
    probes = io.parquet(spark, sf, "part").select(F.translate(F.lower(F.element_at(F.split("p_type", " "), 1)), "aeo", "o3a").alias("probe")).distinct()
    scored = probes.join(F.broadcast(forms), F.abs(F.length("probe") - F.length("form")) <= F.greatest(F.length("probe"), F.length("form"))).withColumn("ratio", F.round(F.expr(text.indel_ratio("probe", "form")), 6))
    return scored.groupBy("probe").agg(F.max_by("form", F.struct("ratio", -F.col("ord"))).alias("form"), F.max("ratio").alias("ratio"))


_NC = "translate(regexp_replace(upper({}),'[^A-Z0-9]','','g'),'OQDILSBZG','000115826')"


@query(f"SELECT c_custkey, {_NC.format('c_name')} AS code FROM customer")
def q24_code_normalise(spark, sf):
    return io.parquet(spark, sf, "customer").select("c_custkey", text.normalise_code(F.col("c_name")).alias("code"))


_Q25 = "substr(c_name, length(c_name)-7)"


@query(f"""WITH q AS (SELECT s_suppkey, substr(s_name, length(s_name)-7) AS code, s_nationkey, s_acctbal FROM supplier), p AS (SELECT c_custkey, {_Q25} AS code, c_nationkey, c_acctbal FROM customer),
d AS (SELECT s_suppkey, c_custkey, levenshtein(q.code,p.code) AS dist, s_nationkey=c_nationkey AS same, abs(s_acctbal-c_acctbal) AS gap FROM q, p WHERE levenshtein(q.code,p.code)<=2),
s AS (SELECT s_suppkey, c_custkey, round(CASE dist WHEN 0 THEN 0.7 WHEN 1 THEN 0.45 ELSE 0.25 END + CASE WHEN same THEN 0.04 ELSE 0 END + CASE WHEN gap<=1000 THEN 0.1 WHEN gap>3000 THEN -0.2 ELSE 0 END,3)::DOUBLE AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS rank FROM s WHERE score>=0.175) SELECT s_suppkey, c_custkey, score, CAST(rank AS INT) AS rank FROM k WHERE rank<=2""")
def q25_link_candidates(spark, sf):
    q = io.parquet(spark, sf, "supplier").select("s_suppkey", F.expr("substring(s_name, length(s_name)-7)").alias("q_code"), "s_nationkey", "s_acctbal")
    p = io.parquet(spark, sf, "customer").select("c_custkey", F.expr("substring(c_name, length(c_name)-7)").alias("p_code"), "c_nationkey", "c_acctbal")
    p = linking.smallest(p, "c_custkey", ["p_code", "c_nationkey", "c_acctbal"], 2)
    gap = F.abs(F.col("s_acctbal") - F.col("c_acctbal"))
    score = linking.code_score(F.col("distance"), F.length("q_code")) + linking.attribute_score(F.col("s_nationkey") == F.col("c_nationkey"), gap <= 1000, gap > 3000)
    at = lambda d: lambda left: linking.at_distance(left, p, "q_code", "p_code", d).withColumn("score", score)
    most = linking.SAME_NUMBER + linking.NEAR_AMOUNT
    best = linking.climb(q, [(points + most, at(d)) for d, points in linking.BY_DISTANCE.items()], "s_suppkey", "c_custkey", linking.KEEP, 2, 3)
    return best.select("s_suppkey", "c_custkey", "score", "rank")


@query("SELECT l_partkey AS code, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS first_owner, max(l_suppkey) AS last_owner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey)>1")
def q26_duplicate_codes(spark, sf):
    return linking.shared_codes(io.parquet(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("code")), "owner", "code").select("code", "n", "first_owner", "last_owner")


_EV = "(SELECT user_id, event_id, ts, CASE WHEN event_type='view' THEN NULL ELSE value END AS v FROM events)"


@query(f"""WITH w AS (SELECT user_id, event_id, v, last_value(v IGNORE NULLS) OVER o AS pv, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER o AS pe FROM {_EV} WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT user_id, event_id, pe AS prev FROM w WHERE v<pv)
SELECT user_id, event_id FROM b UNION SELECT user_id, prev FROM b""")
def q27_out_of_order(spark, sf):
    events = io.parquet(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return rules.out_of_order(events.select("user_id", "event_id", "v"), "user_id", "event_id", "v")


@query(f"WITH p AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM {_EV}) SELECT user_id, event_id, v, previous FROM p WHERE abs(v-previous)>100")
def q28_jump_flags(spark, sf):
    events = io.parquet(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return rules.jumps(events.select("user_id", "event_id", "v"), "user_id", "event_id", "v", 100.0).select("user_id", "event_id", "v", "previous")


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) FILTER (WHERE l_discount>=0.05) OVER (PARTITION BY l_orderkey, l_returnflag) AS n, l_discount>=0.05 AS t FROM lineitem) SELECT l_orderkey, l_linenumber, n AS n_ticked FROM w WHERE t AND n>1")
def q29_exclusive_groups(spark, sf):
    li = io.parquet(spark, sf, "lineitem").withColumn("ticked", F.col("l_discount") >= 0.05)
    return rules.several_ticked(li.select("l_orderkey", "l_linenumber", "l_returnflag", "ticked"), "l_orderkey", "l_returnflag", "ticked").select("l_orderkey", "l_linenumber", "n_ticked")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE (o_orderkey//3)%3 WHEN 0 THEN true WHEN 1 THEN false END AS b, CASE WHEN o_orderkey%2=0 THEN 'NOT_PROVIDED' ELSE 'KNOWN' END AS s FROM orders), c AS (SELECT *, CASE WHEN a THEN a ELSE b END AS x FROM r)
SELECT o_orderkey, CASE WHEN x THEN 'true' WHEN NOT x THEN 'false' END AS either, CASE WHEN s='NOT_PROVIDED' AND coalesce(NOT x,false) THEN 'NOT_APPLICABLE' ELSE s END AS status FROM c""")
def q30_tri_state_rules(spark, sf):
    k = F.col("o_orderkey")
    a, b = (F.when(x % 3 == 0, True).when(x % 3 == 1, False) for x in (k, F.floor(k / 3)))
    either = rules.python_or(a, b)
    return io.parquet(spark, sf, "orders").select("o_orderkey", either.cast("string").alias("either"), rules.not_applicable(F.when(k % 2 == 0, "NOT_PROVIDED").otherwise("KNOWN"), ~either).alias("status"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%4=0 THEN 'confirmed' ELSE 'ocr' END AS source, o_totalprice AS value FROM orders WHERE o_orderkey%3<>0), n AS (SELECT o_orderkey AS k, 'ocr' AS source, o_totalprice+1 AS value FROM orders WHERE o_orderkey%5<>0)
SELECT k, CASE WHEN o.k IS NOT NULL AND (o.source='confirmed' OR n.k IS NULL) THEN o.source ELSE n.source END AS source, CASE WHEN o.k IS NOT NULL AND (o.source='confirmed' OR n.k IS NULL) THEN o.value ELSE n.value END AS value FROM o FULL JOIN n USING (k)""")
def q31_merge_precedence(spark, sf):
    o = io.parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    old = o.where("k % 3 <> 0").withColumn("source", F.when(F.col("k") % 4 == 0, "confirmed").otherwise("ocr"))
    return records.merge_extraction(old, o.where("k % 5 <> 0").withColumns({"value": F.col("value") + 1, "source": F.lit("ocr")}), ["k"], ["source", "value"])


_FIELD = "(SELECT o_custkey AS patient, o_orderpriority AS field, o_orderkey AS seq, CASE o_orderkey%4 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'NOT_PROVIDED' WHEN 2 THEN 'UNKNOWN' ELSE 'NEEDS_REVIEW' END AS status, o_totalprice AS value FROM orders)"
_FOLD = f"WITH f AS {_FIELD}, p AS (SELECT patient, field, arg_max(value, seq) AS value, arg_max(status, seq) AS status FROM f WHERE status IN ('KNOWN','UNKNOWN','NOT_APPLICABLE') GROUP BY 1,2)"


def _fields(spark, sf):
    k = F.col("o_orderkey")
    return io.parquet(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("field"), k.alias("at"), F.when(k % 4 == 0, "KNOWN").when(k % 4 == 1, "NOT_PROVIDED").when(k % 4 == 2, "UNKNOWN").otherwise("NEEDS_REVIEW").alias("status"), F.col("o_totalprice").alias("value"))


@query(_FOLD + " SELECT * FROM p")
def q32_profile_fold(spark, sf):
    return records.profile_fold(_fields(spark, sf), ["patient", "field"], "at", "value", "status")


@query(_FOLD + ", n AS (SELECT patient, field, arg_max(value, seq) AS value, arg_max(status, seq) AS status FROM f GROUP BY 1,2) SELECT p.patient, p.field, p.value AS old_value, p.status AS old_status, n.value AS new_value, n.status AS new_status FROM p JOIN n USING (patient, field) WHERE (n.status='KNOWN' OR p.status='KNOWN') AND (p.value IS DISTINCT FROM n.value OR p.status IS DISTINCT FROM n.status)")
def q33_profile_diff(spark, sf):
    f = _fields(spark, sf)
    new = records.latest_version(f.select("patient", "field", "at", "value", "status").withColumn("key", F.struct("patient", "field")), "key", "at", "at").select("key.patient", "key.field", "value", "status")
    return records.profile_diff(records.profile_fold(f, ["patient", "field"], "at", "value", "status"), new, ["patient", "field"], "value", "status")


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, l_extendedprice DESC) AS p FROM lineitem) SELECT l_orderkey, l_quantity, l_linenumber, l_extendedprice FROM k WHERE p=1")
def q34_version_upsert(spark, sf):
    return records.latest_version(io.parquet(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS question FROM orders WHERE o_orderkey%4<>0 AND (o_orderstatus='P' OR o_orderkey%10=0)")
def q35_review_queue(spark, sf):
    k = F.col("o_orderkey")
    need = records.needs_review(F.when(k % 4 == 0, "confirmed").otherwise("ocr"), F.when(F.col("o_orderstatus") == "P", "NEEDS_REVIEW").otherwise("KNOWN"), k % 10 == 0)
    return io.parquet(spark, sf, "orders").where(need).select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("question"))


@query("SELECT l_orderkey, bool_and(l_returnflag IN ('N','A')) AS validated FROM lineitem GROUP BY 1")
def q36_validated_records(spark, sf):
    li = io.parquet(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag").isin("N", "A"), "confirmed").otherwise("ocr").alias("source"))
    return records.validated(li, "l_orderkey")


_EVENT_EDGES = {"signup": ["view"], "view": ["click", "purchase"], "click": ["view", "purchase", "error"], "purchase": ["view"], "error": ["view"]}
_EDGE_SQL = "(SELECT * FROM (VALUES " + ",".join(f"('{a}','{b}')" for a, t in _EVENT_EDGES.items() for b in t) + ") e(from_state,to_state))"


@query(f"WITH s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, event_type AS to_state FROM events) SELECT user_id, event_id, from_state, to_state FROM s ANTI JOIN {_EDGE_SQL} USING (from_state, to_state) WHERE from_state<>to_state")
def q37_illegal_transitions(spark, sf):
    return lifecycle.illegal(io.parquet(spark, sf, "events").select("user_id", "event_id", "event_type"), lifecycle.edges(spark, _EVENT_EDGES), "user_id", "event_id", "event_type")


@query("WITH k AS (SELECT user_id||':'||event_type||':'||CAST(floor(value) AS BIGINT) AS key, event_id, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS p FROM k) SELECT key, event_id, value FROM r WHERE p=1")
def q38_idempotent_ingest(spark, sf):
    e = io.parquet(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string")).alias("key"), "event_id", "value")
    return lifecycle.first_by_key(e.unionByName(e), "key", "event_id")


@query("SELECT l_orderkey, CASE WHEN bool_or(l_linestatus='O' AND l_quantity<10) THEN 'WAITING' WHEN bool_or(l_returnflag='R') THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'AI_PROCESSED' END AS state FROM lineitem GROUP BY 1")
def q39_settle_records(spark, sf):
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10), "stored").when(F.col("l_returnflag") == "R", "failed").otherwise("done")
    return lifecycle.settled(io.parquet(spark, sf, "lineitem").withColumn("status", status), "l_orderkey", F.col("status"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def q40_missing_jobs(spark, sf):
    done = io.parquet(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lifecycle.missing_jobs(io.parquet(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT o_orderkey, least(600.0, pow(2.0, o_orderkey%12)) AS wait FROM orders")
def q41_backoff_schedule(spark, sf):
    return io.parquet(spark, sf, "orders").select("o_orderkey", lifecycle.backoff(F.col("o_orderkey") % 12).alias("wait"))


@query(f"SELECT user_id, arg_max(v, event_id) AS v FROM {_EV} WHERE v IS NOT NULL GROUP BY 1")
def q42_latest_known(spark, sf):
    return records.latest_known(io.parquet(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value"))), "user_id", "event_id", "v")


@query("""WITH u AS (SELECT label, generate_subscripts(embedding,1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS cl, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY 1,2) GROUP BY 1),
s AS (SELECT vec_id, cl, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS p FROM s)
SELECT vec_id, max(cl) FILTER (WHERE p=1) AS best, round(max(s) FILTER (WHERE p=1) - max(s) FILTER (WHERE p=2),4) AS margin FROM r GROUP BY 1""")
def q43_argmax_margin(spark, sf):
    e = io.parquet(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    flat = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = flat.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(F.col("label").alias("cl"), F.col("c.m").alias("c"))
    dot = lambda a, b: f"aggregate(zip_with({a},{b},(x,y)->x*y),0D,(s,x)->s+x)"
    # One row for each label: a list of fixed size.
    s = e.select("vec_id", "e").crossJoin(F.broadcast(centres)).select("vec_id", "cl", F.expr(f"{dot('e','c')}/sqrt({dot('e','e')}*{dot('c','c')})").alias("s"))
    top = s.groupBy("vec_id").agg(F.max_by("cl", "s").alias("best"), F.sort_array(F.collect_list("s"), False).alias("all"))
    return top.select("vec_id", "best", F.round(F.get("all", 0) - F.get("all", 1), 4).alias("margin"))


@query("SELECT conv_id||':'||turn AS id, role AS sender, CASE turn%3 WHEN 0 THEN 'text' WHEN 1 THEN 'interactive' ELSE 'image' END AS type, sha256(CASE turn%3 WHEN 0 THEN text WHEN 1 THEN 'b'||turn ELSE 'i'||conv_id END) AS content_sha256 FROM conversations")
def q44_webhook_flatten(spark, sf):
    kind = F.expr("case turn % 3 when 0 then 'text' when 1 then 'interactive' else 'image' end")
    message = F.struct(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("from"), kind.alias("type"), F.struct(F.col("text").alias("body")).alias("text"), F.struct(F.concat(F.lit("i"), F.col("conv_id").cast("string")).alias("id")).alias("image"),
        F.struct(F.struct(F.concat(F.lit("b"), F.col("turn").cast("string")).alias("id")).alias("button_reply")).alias("interactive"),
    )
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.array(message).alias("messages")).alias("value"))).alias("changes"))).alias("entry")))
    return io.webhook_messages(io.parquet(spark, sf, "conversations").select(body.alias("body")), "body").select("id", "sender", "type", F.sha2("content", 256).alias("content_sha256"))


_BOX = [("b%d" % k, 1 + 5 * (k % 10), 1 + 5 * (k % 10) + 3, 900 + 200 * (k // 10), 900 + 200 * (k // 10) + 150) for k in range(50)]
_BOX_SQL = "(SELECT * FROM (VALUES " + ",".join(f"('{n}',{a},{b},{c},{d})" for n, a, b, c, d in _BOX) + ") v(box,x0,x1,y0,y1))"


def _points(spark, sf):
    return io.parquet(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), spark.createDataFrame(_BOX, "box string, x0 int, x1 int, y0 int, y1 int")


@query(f"SELECT p_partkey, box FROM part JOIN {_BOX_SQL} ON p_size BETWEEN x0-0 AND x1 AND p_retailprice BETWEEN y0 AND y1")
def q45_spatial_containment(spark, sf):
    return datasets.contained(*_points(spark, sf), []).select("p_partkey", "box")


@query(f"SELECT p_partkey FROM part ANTI JOIN {_BOX_SQL} ON p_size BETWEEN x0-0.5 AND x1+0.5 AND p_retailprice BETWEEN y0-0.5 AND y1+0.5")
def q46_unassigned_anti(spark, sf):
    return datasets.contained(*_points(spark, sf), [], 0.5, "left_anti").select("p_partkey")


@query("SELECT CASE WHEN doc_id%10+1<=5 THEN 'calib' ELSE 'test' END AS split, lang, source, count(*) AS n FROM documents GROUP BY 1,2,3")
def q47_split_cube(spark, sf):
    return io.parquet(spark, sf, "documents").groupBy(datasets.split_of(F.col("doc_id") % 10 + 1, 5).alias("split"), "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS p FROM documents) SELECT doc_id, sha FROM k WHERE p=1")
def q48_content_dedup(spark, sf):
    return datasets.first_by_content(io.parquet(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey%8, o_custkey, o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('F','P')")
def q49_interleave_sample(spark, sf):
    order = Window.partitionBy("o_orderpriority").orderBy(F.pmod("o_orderkey", F.lit(8)), "o_custkey", "o_orderkey")
    return io.parquet(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", F.row_number().over(order).cast("bigint").alias("place"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size*4<85 THEN 'low_resolution' END, CASE WHEN p_retailprice/25<40 THEN 'blurred' END, CASE WHEN p_size*3<60 THEN 'dark' END) AS issues FROM part")
def q50_quality_gate(spark, sf):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return io.parquet(spark, sf, "part").select("p_partkey", F.concat_ws(",", F.when(s * 4 < 85, "low_resolution"), F.when(r / 25 < 40, "blurred"), F.when(s * 3 < 60, "dark")).alias("issues"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text,'[؀-ٟ٪-ۯۺ-ۿ]') THEN 'arabic_script' WHEN regexp_matches(text,'[٠-٩۰-۹]') THEN 'eastern_digits' ELSE 'latin' END AS script FROM documents")
def q51_script_of(spark, sf):
    return io.parquet(spark, sf, "documents").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query("WITH k AS (SELECT o_custkey AS patient, o_orderpriority AS code, arg_min(o_orderpriority, o_orderkey) AS spelling, max(o_orderkey) AS last FROM orders GROUP BY 1,2) SELECT patient, spelling AS code, row_number() OVER (PARTITION BY patient ORDER BY last, spelling) AS ord FROM k")
def q52_code_order(spark, sf):
    o = io.parquet(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("code"), F.upper("o_orderpriority").alias("key"), "o_orderkey")
    return records.code_order(o, "patient", "code", "key", "o_orderkey").select("patient", "code", F.col("ord").cast("bigint").alias("ord"))


@query("SELECT event_id, CASE WHEN abs(value/1000.0-0.06)<0.08 THEN least(0.995::DOUBLE, 0.5::DOUBLE+abs(value/1000.0-0.06)/0.08*0.5) ELSE 0.995 END::DOUBLE AS confidence FROM events")
def q53_checkbox_confidence(spark, sf):
    return io.parquet(spark, sf, "events").select("event_id", confidence.checkbox_confidence(F.col("value") / 1000.0).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, coalesce(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 60) > 45, false) AS inconsistent FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def q54_date_gap_rule(spark, sf):
    li, o = io.parquet(spark, sf, "lineitem"), io.parquet(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", rules.apart(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"), 60, 45).alias("inconsistent"))


_READING = """CASE p_partkey%8 WHEN 0 THEN '31/02/2025' WHEN 1 THEN (80+p_size)||' / '||(40+p_size) WHEN 2 THEN p_size||' kg' WHEN 3 THEN CASE WHEN p_size%2=0 THEN 'OUI' ELSE 'non.' END WHEN 4 THEN lower(p_brand)||'/' WHEN 5 THEN CASE WHEN p_size%2=0 THEN 'negatf' ELSE 'q'||p_size END WHEN 6 THEN p_name WHEN 7 THEN CASE WHEN p_size%2=0 THEN '?' ELSE '' END END"""


@query(f"""WITH r AS (SELECT p_partkey, p_size, p_brand, p_partkey%8 AS k, {_READING} AS raw FROM part)
SELECT p_partkey, CASE WHEN k<7 THEN 'KNOWN' WHEN p_size%2=0 THEN 'UNKNOWN' ELSE 'NOT_PROVIDED' END AS status,
CASE k WHEN 1 THEN replace(raw,' ','') WHEN 2 THEN CAST(CAST(CASE WHEN p_size>30 THEN round_even(p_size/10.0,0) ELSE p_size END AS BIGINT) AS VARCHAR) WHEN 3 THEN CASE WHEN p_size%2=0 THEN 'true' ELSE 'false' END WHEN 4 THEN upper(replace(p_brand,'#','')) WHEN 5 THEN CASE WHEN p_size%2=0 THEN 'negative' ELSE raw END WHEN 7 THEN NULL ELSE raw END AS value,
k<>0 AND NOT (k=5 AND p_size%2=1) AS ok, CASE WHEN k=5 AND p_size%2=0 THEN round(12/13::DOUBLE,6) WHEN k=5 THEN 0.0 ELSE 1.0 END::DOUBLE AS lexicon_score,
CASE WHEN k=0 THEN 'date_unparsed' WHEN k=2 AND p_size>30 THEN 'repaired' WHEN k=5 AND p_size%2=1 THEN 'not_in_vocabulary' ELSE '' END AS flags FROM r""")
def q55_parse_values(spark, sf):
    k = F.col("p_partkey") % 8
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("date", "bp", "int", "bool", "code", "enum", "text", "text"))), (k + 1).cast("int"))
    readings = io.parquet(spark, sf, "part").select("p_partkey", F.expr(_READING).alias("raw"), kinds.alias("value_type"), F.when(k == 5, "test_result").alias("vocabulary"), F.lit("kg").alias("unit"), F.lit(0.0).alias("low"), F.lit(30.0).alias("high"))
    out = parsing.parse_values(readings)
    return out.select("p_partkey", "parsed.status", "parsed.value", "parsed.ok", F.round("parsed.lexicon_score", 6).alias("lexicon_score"), F.concat_ws(",", "parsed.flags").alias("flags"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey%6 AS g, o_custkey%4 AS p, o_custkey%9 AS l, o_orderkey%3=0 AS v FROM orders),
f AS (SELECT k, 'history.gravidity' AS field, 'KNOWN' AS status, CASE WHEN p>g THEN 'parity_exceeds_gravidity' ELSE '' END AS flags FROM o
UNION ALL SELECT k, 'history.parity', 'KNOWN', concat_ws(',', CASE WHEN p>g THEN 'parity_exceeds_gravidity' END, CASE WHEN l>p+2 THEN 'living_children_exceed_parity' END) FROM o
UNION ALL SELECT k, 'history.living_children', 'KNOWN', CASE WHEN l>p+2 THEN 'living_children_exceed_parity' ELSE '' END FROM o
UNION ALL SELECT k, 'history.rubella_vaccinated', 'KNOWN', '' FROM o
UNION ALL SELECT k, 'history.rubella_date', CASE WHEN v THEN 'NOT_PROVIDED' ELSE 'NOT_APPLICABLE' END, CASE WHEN v THEN '' ELSE 'not_applicable:not_vaccinated' END FROM o
UNION ALL SELECT k, 'history.prev3.date', CASE WHEN p<3 THEN 'NOT_APPLICABLE' ELSE 'NOT_PROVIDED' END, CASE WHEN p<3 THEN 'not_applicable:beyond_parity' ELSE '' END FROM o) SELECT * FROM f""")
def q56_page_rules(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = {"gravidity": k % 6, "parity": c % 4, "living_children": c % 9, "rubella_vaccinated": k % 3 == 0, "rubella_date": None, "prev3.date": None}
    fields = F.array(*(F.struct(F.lit(f"history.{name}").alias("field"), F.lit("NOT_PROVIDED" if value is None else "KNOWN").alias("status"), (F.lit(None) if value is None else value).cast("string").alias("value")) for name, value in said.items()))
    rows = io.parquet(spark, sf, "orders").select(k.alias("page"), F.lit("history").alias("page_type"), F.inline(fields))
    rows = rows.withColumns({"source": F.lit("ocr"), "flags": F.array().cast("array<string>"), "exclusive_group": F.lit(None).cast("string")})
    return page_rules.apply_rules(rows).select(F.col("page").alias("k"), "field", "status", F.concat_ws(",", "flags").alias("flags"))


from . import catalogue_records  # noqa: E402, F401  registers its queries here

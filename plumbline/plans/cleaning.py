"""Sources, cleaning and derivations on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as fc
from ..functions import derive as fd
from ..operators import clean
from ..session import shared_dir
from ..sources import tables as src
from .registry import load, query

# A column with gaps, written the same way in both engines.
GAPPY = "CASE WHEN value > 60 AND value < 90 THEN NULL ELSE value END"


@query("read_table", """
SELECT l_returnflag, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity
FROM (SELECT DISTINCT * FROM lineitem) GROUP BY l_returnflag
""")
def _(spark, d):
    rows = src.read_table(spark, "parquet", f"{d}/lineitem.parquet")
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("conform_schema", """
SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer,
       CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DOUBLE) AS price,
       CAST(NULL AS INTEGER) AS rating
FROM orders
""")
def _(spark, d):
    target = T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            T.StructField("customer", T.StringType()),
            T.StructField("day", T.DateType()),
            T.StructField("price", T.DoubleType()),
            T.StructField("rating", T.IntegerType()),
        ]
    )
    names = {
        "o_orderkey": "order_id", "o_custkey": "customer", "o_orderdate": "day", "o_totalprice": "price",
    }
    return src.conform_schema(load(spark, d, "orders"), target, names)[0]


@query("exclude_files", """
SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_orderstatus
""")
def _(spark, d):
    both = spark.read.option("mergeSchema", "true").parquet(f"{d}/orders.parquet", f"{d}/customer.parquet")
    kept = src.exclude_files(both, r"customer.*\.parquet")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query("slice_period", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE year(o_orderdate) >= 1996 AND (year(o_orderdate) < 1998
   OR (year(o_orderdate) = 1998 AND month(o_orderdate) <= 3))
""")
def _(spark, d):
    return src.slice_period(load(spark, d, "orders"), "o_orderdate", 1998, 3, 1996).select(
        "o_orderkey", "o_orderdate"
    )


@query("write_checkpoint", """
SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS missing, count(*) AS total,
       count(*) FILTER (o_orderkey IS NULL) * 100.0::DOUBLE / count(*) AS pct FROM orders
UNION ALL
SELECT 'price', count(*) FILTER (o_totalprice >= 200000), count(*),
       round(count(*) FILTER (o_totalprice >= 200000) * 100.0::DOUBLE / count(*), 6) FROM orders
""")
def _(spark, d):
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    orders = load(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") < 200000, F.col("o_totalprice")).alias("price")
    )
    src.write_checkpoint(orders, path)
    return src.read_checkpoint(spark, path)[1].withColumn("pct", F.round("pct", 6))


@query("pipeline_manifest", """
WITH s0 AS (SELECT o_orderdate, o_orderstatus FROM orders),
s1 AS (SELECT * FROM s0 WHERE o_orderdate < TIMESTAMP '1999-01-01'),
m AS (
 SELECT 0 AS stage_no, 'loaded' AS stage, 6 AS n_columns, count(*) AS "rows",
   CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS positives, avg((o_orderstatus = 'F')::INT) AS rate,
   min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM s0
 UNION ALL
 SELECT 1, 'sliced', 6, count(*), CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT),
   avg((o_orderstatus = 'F')::INT), min(o_orderdate), max(o_orderdate) FROM s1
 UNION ALL
 SELECT 2, 'with month', 7, count(*), CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT),
   avg((o_orderstatus = 'F')::INT), min(o_orderdate), max(o_orderdate) FROM s1)
SELECT stage_no, stage, n_columns, "rows", positives, round(rate, 6) AS rate, first_date, last_date,
  lag("rows") OVER (ORDER BY stage_no) - "rows" AS rows_removed,
  n_columns - lag(n_columns) OVER (ORDER BY stage_no) AS columns_added FROM m
""")
def _(spark, d):
    loaded = load(spark, d, "orders")
    sliced = src.slice_period(loaded, "o_orderdate", 1998)
    stages = [
        ("loaded", loaded),
        ("sliced", sliced),
        ("with month", sliced.withColumn("month", F.month("o_orderdate"))),
    ]
    out = src.pipeline_manifest(stages, F.col("o_orderstatus") == "F", "o_orderdate")
    return out.withColumn("rate", F.round("rate", 6))


@query("select_existing", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def _(spark, d):
    wanted = ["l_orderkey", "no_such_column", "l_quantity", "l_shipdate"]
    return clean.select_existing(load(spark, d, "lineitem"), wanted)


@query("null_report", """
WITH t AS (SELECT l_orderkey, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS quantity,
                  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
SELECT "column", missing, total, round(missing * 100.0::DOUBLE / total, 6) AS pct FROM (
 SELECT 'l_orderkey' AS "column", count(*) - count(l_orderkey) AS missing, count(*) AS total FROM t
 UNION ALL SELECT 'quantity', count(*) - count(quantity), count(*) FROM t
 UNION ALL SELECT 'flag', count(*) - count(flag), count(*) FROM t)
""")
def _(spark, d):
    t = load(spark, d, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
    )
    return clean.null_report(t).withColumn("pct", F.round("pct", 6))


@query("missing_report", f"""
WITH t AS (SELECT event_id, {GAPPY} AS gappy,
    CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE ELSE {GAPPY} END AS noisy FROM events)
SELECT 'raw' AS stage, "column", missing, total, round(missing * 100.0::DOUBLE / total, 6) AS pct FROM (
 SELECT 'event_id' AS "column", count(*) - count(event_id) AS missing, count(*) AS total FROM t
 UNION ALL SELECT 'gappy', count(*) - count(gappy), count(*) FROM t
 UNION ALL SELECT 'noisy', count(*) FILTER (noisy IS NULL OR isnan(noisy)), count(*) FROM t)
""")
def _(spark, d):
    t = load(spark, d, "events").select(
        "event_id",
        F.expr(GAPPY).alias("gappy"),
        F.expr(f"CASE WHEN event_type = 'view' THEN double('NaN') ELSE {GAPPY} END").alias("noisy"),
    )
    return clean.missing_report(t, "raw").withColumn("pct", F.round("pct", 6))


@query("drop_sparse", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_discount > 0.01 THEN NULL ELSE l_discount END AS kept_discount FROM lineitem
""")
def _(spark, d):
    t = load(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_discount") <= 0.01, F.col("l_discount")).alias("kept_discount"),
        F.when(F.col("l_tax") <= 0.01, F.col("l_tax")).alias("sparse_tax"),
    )
    return clean.drop_sparse(t, 0.6, keep=["kept_discount"])


@query("require", """
SELECT count(*) AS rows_before, count(*) FILTER (p IS NOT NULL AND s IS NOT NULL) AS rows_after,
  count(*) - count(p) AS missing_price, count(*) - count(s) AS missing_status
FROM (SELECT CASE WHEN o_totalprice < 300000 THEN o_totalprice END AS p,
             CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders)
""")
def _(spark, d):
    t = load(spark, d, "orders").select(
        F.when(F.col("o_totalprice") < 300000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
    )
    return clean.required_counts(t, ["price", "status"])


@query("drop_where", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'
""")
def _(spark, d):
    gone = F.expr("CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END")
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.drop_where(t, gone)


@query("dedupe", """
SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)
""")
def _(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.md5("text").alias("text_key"))
    return clean.dedupe(t, ["text_key"], [F.col("doc_id")])


@query("duplicate_groups", """
SELECT md5(text) AS text_key, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def _(spark, d):
    t = load(spark, d, "documents").select(F.md5("text").alias("text_key"))
    return clean.duplicate_groups(t, ["text_key"])


@query("dedupe_ranked", """
SELECT user_id, day, event_id, event_type FROM (
 SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, row_number() OVER (
   PARTITION BY user_id, CAST(ts AS DATE)
   ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id) AS rn
 FROM events) WHERE rn = 1
""")
def _(spark, d):
    t = load(spark, d, "events").select(
        "user_id", F.col("ts").cast("date").alias("day"), "event_id", "event_type", "ts"
    )
    best = clean.dedupe_ranked(
        t, ["user_id", "day"], "event_type", ["purchase", "click"], [F.desc("ts"), F.col("event_id")]
    )
    return best.drop("ts")


@query("to_double_safe", """
SELECT doc_id, TRY_CAST(regexp_replace(source, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS source_no,
  TRY_CAST(regexp_replace(lang || n_chars || ' chars', '[^0-9.\\-]', '', 'g') AS DOUBLE) AS chars
FROM documents
""")
def _(spark, d):
    return load(spark, d, "documents").select(
        "doc_id",
        fc.to_double_safe(F.col("source")).alias("source_no"),
        fc.to_double_safe(F.concat("lang", "n_chars", F.lit(" chars"))).alias("chars"),
    )


@query("blank_to_null", """
WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'NA' WHEN 'de' THEN '  ' ELSE lang END AS lang,
   CASE source WHEN 'src1' THEN '' ELSE source END AS source FROM documents)
SELECT doc_id, CASE WHEN trim(lang) IN ('', 'NA') THEN NULL ELSE lang END AS lang,
  CASE WHEN trim(source) IN ('', 'NA') THEN NULL ELSE source END AS source FROM t
""")
def _(spark, d):
    t = load(spark, d, "documents").select(
        "doc_id",
        F.expr("CASE lang WHEN 'en' THEN 'NA' WHEN 'de' THEN '  ' ELSE lang END").alias("lang"),
        F.expr("CASE source WHEN 'src1' THEN '' ELSE source END").alias("source"),
    )
    return clean.blank_to_null(t)


MEASURE = (
    "CASE event_type WHEN 'view' THEN 'T' WHEN 'click' THEN concat(CAST(event_id AS {s}), 's')"
    " WHEN 'error' THEN ' ' ELSE CAST(event_id AS {s}) END"
)


@query("parse_measure", f"""
SELECT event_id, CASE WHEN trim(m) = 'T' THEN 0.0::DOUBLE
  ELSE TRY_CAST(regexp_replace(trim(m), 's$', '') AS DOUBLE) END AS amount
FROM (SELECT event_id, {MEASURE.format(s='VARCHAR')} AS m FROM events)
""")
def _(spark, d):
    raw = F.expr(MEASURE.format(s="STRING"))
    return load(spark, d, "events").select("event_id", fc.parse_measure(raw).alias("amount"))


@query("clip_to_null", """
SELECT event_id, CASE WHEN value BETWEEN 5 AND 150 THEN value END AS value,
  CASE WHEN user_id BETWEEN 2 AND 90 THEN user_id END AS user_id FROM events
""")
def _(spark, d):
    t = load(spark, d, "events").select("event_id", "value", "user_id")
    return clean.clip_to_null(t, {"value": (5, 150), "user_id": (2, 90)})


@query("clean_code", """
SELECT c_custkey, nullif(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), '') AS code,
  nullif(regexp_replace(upper(c_mktsegment), '[^A-Z0-9]', '', 'g'), '') AS segment FROM customer
""")
def _(spark, d):
    return load(spark, d, "customer").select(
        "c_custkey",
        fc.clean_code(F.col("c_name")).alias("code"),
        fc.clean_code(F.col("c_mktsegment")).alias("segment"),
    )


NONFINITE = (
    "CASE event_type WHEN 'view' THEN {nan} WHEN 'click' THEN {inf} WHEN 'error' THEN -{inf} ELSE value END"
)


@query("replace_nonfinite", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN -1.0::DOUBLE ELSE value END AS v
FROM events
""")
def _(spark, d):
    v = F.expr(NONFINITE.format(nan="double('NaN')", inf="double('Infinity')"))
    return clean.replace_nonfinite(load(spark, d, "events").select("event_id", v.alias("v")), -1.0)


@query("impute_global", f"""
WITH t AS (SELECT event_id, {GAPPY} AS v, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind,
   CASE WHEN value > 100 THEN NULL ELSE user_id END AS u FROM events)
SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t)), 6) AS v,
  coalesce(kind, 'UNK') AS kind,
  coalesce(u, (SELECT u FROM t WHERE u IS NOT NULL GROUP BY u ORDER BY count(*) DESC, u LIMIT 1)) AS u FROM t
""")
def _(spark, d):
    t = load(spark, d, "events").select(
        "event_id",
        F.expr(GAPPY).alias("v"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        F.when(F.col("value") <= 100, F.col("user_id")).alias("u"),
    )
    filled = clean.impute_global(t, {"v": "median", "u": "mode", "kind": "constant:UNK"})
    return filled.withColumn("v", F.round("v", 6))


@query("impute_group", f"""
WITH t AS (SELECT event_id, event_type, {GAPPY} AS v, CASE WHEN value > 100 THEN NULL ELSE user_id END AS u
   FROM events),
m AS (SELECT event_type, quantile_cont(v, 0.5) AS med FROM t GROUP BY 1),
c AS (SELECT event_type, u, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, u) AS rn
   FROM t WHERE u IS NOT NULL GROUP BY 1, 2)
SELECT event_id, round(coalesce(v, med), 6) AS v, coalesce(t.u, c.u) AS u
FROM t LEFT JOIN m USING (event_type) LEFT JOIN c ON c.event_type = t.event_type AND rn = 1
""")
def _(spark, d):
    t = load(spark, d, "events").select(
        "event_id",
        "event_type",
        F.expr(GAPPY).alias("v"),
        F.when(F.col("value") <= 100, F.col("user_id")).alias("u"),
    )
    filled = clean.impute_group(clean.impute_group(t, ["event_type"], "v"), ["event_type"], "u", "mode")
    return filled.select("event_id", F.round("v", 6).alias("v"), "u")


@query("impute_tiered", f"""
WITH t AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, {GAPPY} AS v FROM events)
SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY user_id ORDER BY s
   RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), (SELECT quantile_cont(v, 0.5) FROM t)), 6) AS v FROM t
""")
def _(spark, d):
    t = load(spark, d, "events").select("event_id", "user_id", "ts", F.expr(GAPPY).alias("v"))
    return clean.impute_tiered(t, ["user_id"], "ts", ["v"]).select("event_id", F.round("v", 6).alias("v"))


@query("impute_window_mean", f"""
SELECT event_id, round(coalesce({GAPPY}, avg(value) OVER (PARTITION BY user_id)), 6) AS v FROM events
""")
def _(spark, d):
    t = load(spark, d, "events").select("event_id", "user_id", "value", F.expr(GAPPY).alias("v"))
    out = clean.impute_window_mean(t, ["user_id"], "v", "value")
    return out.select("event_id", F.round("v", 6).alias("v"))


@query("log1p_clamped", """
SELECT l_returnflag, round(sum(ln(1 + greatest(l_quantity - 10, 0))), 4) AS logged,
  round(sum(exp(ln(1 + greatest(l_quantity - 10, 0))) - 1), 4) AS back FROM lineitem GROUP BY 1
""")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("x", fc.log1p_clamped(F.col("l_quantity") - 10))
    return t.groupBy("l_returnflag").agg(
        F.round(F.sum("x"), 4).alias("logged"), F.round(F.sum(fc.expm1_of(F.col("x"))), 4).alias("back")
    )


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3,
  quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT count(*) AS n, count(*) FILTER (l_extendedprice < lo) AS n_low,
  count(*) FILTER (l_extendedprice > hi) AS n_high,
  round(count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) * 100.0::DOUBLE / count(*), 4) AS pct_outside,
  round(any_value(p01), 4) AS p01, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
  round(any_value(q3), 4) AS q3, round(any_value(p99), 4) AS p99,
  round(any_value(lo), 4) AS fence_low, round(any_value(hi), 4) AS fence_high
FROM lineitem, f
""")
def _(spark, d):
    out = clean.iqr_outliers(load(spark, d, "lineitem"), "l_extendedprice")
    rounded = [c for c in out.columns if not c.startswith("n")]
    return out.withColumns({c: F.round(c, 4) for c in rounded})


@query("validate_rows", """
SELECT c_custkey, concat_ws('; ', CASE WHEN NOT (c_acctbal - 1000 > 0) THEN 'balance: positive' END, CASE WHEN c_custkey % 5 = 4 THEN 'left: non_negative' END,
   CASE WHEN NOT (c_acctbal / 50 BETWEEN -90 AND 90) THEN 'lat: latitude' END,
   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment: non_empty' END) AS reasons
FROM customer WHERE NOT (c_acctbal - 1000 > 0) OR NOT (c_acctbal / 50 BETWEEN -90 AND 90)
   OR c_mktsegment = 'MACHINERY' OR c_custkey % 5 = 4
""")
def _(spark, d):
    t = load(spark, d, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") - 1000).alias("balance"),
        (3 - F.col("c_custkey") % 5).alias("left"),
        (F.col("c_acctbal") / 50).alias("lat"),
        F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    rules = {"balance": "positive", "left": "non_negative", "lat": "latitude", "segment": "non_empty"}
    rejected = clean.validate_rows(t, rules)[1]
    return rejected.select("c_custkey", F.concat_ws("; ", "reasons").alias("reasons"))


@query("drop_roles", "SELECT l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return clean.drop_roles(
        load(spark, d, "lineitem"), ["l_discount", "l_tax"], ["l_orderkey"], ["partkey", "suppkey", "date"]
    )[0]


@query("audit_types", """
SELECT 'l_quantity' AS "column", 'double' AS actual, 'int' AS expected,
  'try_cast(l_quantity as int)' AS fix, count(*) FILTER (TRY_CAST(l_quantity AS INTEGER) IS NULL) AS lost_values
FROM lineitem
UNION ALL SELECT 'l_returnflag', 'string', 'double', 'try_cast(l_returnflag as double)',
  count(*) FILTER (TRY_CAST(l_returnflag AS DOUBLE) IS NULL) FROM lineitem
UNION ALL SELECT 'l_shipdate', 'timestamp_ntz', 'date', 'try_cast(l_shipdate as date)',
  count(*) FILTER (CAST(l_shipdate AS DATE) IS NULL) FROM lineitem
""")
def _(spark, d):
    expected = {
        "l_orderkey": "bigint", "l_quantity": "int", "l_returnflag": "double", "l_shipdate": "date",
    }
    return clean.audit_types(load(spark, d, "lineitem"), expected)

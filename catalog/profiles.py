"""Profiles, observed types, fingerprints, baselines and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query, table
from tablepact.functions.hashing import dataset_fingerprint, key_digest
from tablepact.operators import drift, profile


def _each(table_name, columns, row):
    return " UNION ALL ".join(
        "SELECT " + row.format(c=c) + f" FROM {table_name}" for c in columns)


NULLED = """(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
             CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS o_totalprice FROM orders)"""


def nulled_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") < 250000, F.col("o_totalprice")).alias("o_totalprice"))


@query("profile_nulls", _each(NULLED, ["o_orderkey", "o_orderstatus", "o_totalprice"], """
    '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
    round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_ratio"""))
def profile_nulls(spark, sf_dir):
    return profile.profile(nulled_orders(spark, sf_dir), distinct="none").select(
        "column", "row_count", "null_count", "null_ratio")


DISTINCT = """SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS distinct_count,
    CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_count
    FROM (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""


def _distinct(t, columns):
    return " UNION ALL ".join(DISTINCT.format(c=c, t=t) for c in columns)


@query("profile_distinct", _distinct("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def profile_distinct(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "documents"))


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_distinct_lineitem", _distinct("lineitem", LINE_COLUMNS))
def profile_distinct_lineitem(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"))


@query("profile_approx_distinct", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", false AS distinct_count_exact, true AS within_tenth FROM lineitem
    HAVING count(*) > 0""" for c in LINE_COLUMNS))
def profile_approx_distinct(spark, sf_dir):
    """Sketched counts beside exact ones: one scan without a shuffle against one with."""
    df = table(spark, sf_dir, "lineitem")
    sketch = profile.profile(df, distinct="approx").select("column", "distinct_count", "distinct_count_exact")
    exact = profile.distinct_counts(df).select("column", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.1
    return sketch.join(exact, "column").select("column", "distinct_count_exact", near.alias("within_tenth"))


NUMBERS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", _each("lineitem", NUMBERS, """
    '{c}' AS "column", CAST(min({c}) AS DOUBLE) + 0.0 AS minimum, CAST(max({c}) AS DOUBLE) + 0.0 AS maximum,
    round(avg({c}), 4) AS mean"""))
def profile_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*NUMBERS)
    return profile.profile(df, distinct="none").select(
        "column", F.col("minimum").cast("double").alias("minimum"),
        F.col("maximum").cast("double").alias("maximum"), F.round("mean", 4).alias("mean"))


@query("profile_datetime", " UNION ALL ".join(f"""
    SELECT '{t}' AS dataset, '{c}' AS "column", strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS minimum,
           strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS maximum FROM {t}"""
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))))
def profile_datetime(spark, sf_dir):
    parts = []
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        df = table(spark, sf_dir, t).select(c)
        parts.append(profile.profile(df, distinct="none").select(
            F.lit(t).alias("dataset"), "column", F.left("minimum", F.lit(19)).alias("minimum"),
            F.left("maximum", F.lit(19)).alias("maximum")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("profile_table", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, CAST(count(*) AS BIGINT) AS row_count, CAST({n} AS BIGINT) AS column_count FROM {t}"
    for t, n in (("orders", 6), ("lineitem", 11), ("documents", 5), ("events", 6))))
def profile_table(spark, sf_dir):
    parts = [profile.table_profile(table(spark, sf_dir, t)).withColumn("dataset", F.lit(t))
             for t in ("orders", "lineitem", "documents", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


TEXTUAL = {
    "as_integer": ("cast(o_orderkey as {text})", "integer"),
    "as_number": ("concat(cast(o_custkey as {text}), '.25')", "number"),
    "as_datetime": ("{day}", "datetime"),
    "as_boolean": ("CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'False' END", "boolean"),
    "as_string": ("o_orderpriority", "string"),
    "as_mixed": ("CASE WHEN o_orderstatus = 'O' THEN '12' ELSE o_orderpriority END", "string"),
}
PARSES = """CASE WHEN count(*) = count(*) FILTER (v IN ('True','False','TRUE','FALSE','true','false')) THEN 'boolean'
    WHEN count(*) = count(*) FILTER (regexp_full_match(v, '\\s*[+-]?\\d+\\s*')) THEN 'integer'
    WHEN count(*) = count(TRY_CAST(v AS DOUBLE)) THEN 'number'
    WHEN count(TRY_CAST(v AS TIMESTAMP)) >= 0.95 * count(*) THEN 'datetime' ELSE 'string' END"""


def text_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[
        F.expr(e.format(text="string", day="date_format(o_orderdate, 'yyyy-MM-dd')")).alias(c)
        for c, (e, _) in TEXTUAL.items()])


def _typed_sql(source="orders"):
    parts = []
    for c, (e, _) in TEXTUAL.items():
        v = e.format(text="varchar", day="strftime(o_orderdate, '%Y-%m-%d')")
        parts.append(f"""SELECT '{c}' AS "column", {PARSES} AS observed_type FROM (SELECT {v} AS v FROM {source})""")
    return " UNION ALL ".join(parts)


@query("profile_observed_type", _typed_sql()
       + """ UNION ALL SELECT 'o_orderkey', CASE WHEN count(o_orderkey) > 0 THEN 'integer' END FROM orders""")
def profile_observed_type(spark, sf_dir):
    return profile.column_stats(text_orders(spark, sf_dir)).select("column", "observed_type")


@query("profile_sampled_type", _typed_sql("(SELECT * FROM orders ORDER BY o_orderkey LIMIT 200)"))
def profile_sampled_type(spark, sf_dir):
    return profile.sampled_types(text_orders(spark, sf_dir), "o_orderkey").select("column", "observed_type")


# --- hashes ----------------------------------------------------------------------

@query("dataset_fingerprint", """
    WITH d AS (SELECT sha256(length(CAST(o_orderkey AS VARCHAR)) || '+' || o_orderkey
                             || length(CAST(o_custkey AS VARCHAR)) || '+' || o_custkey
                             || CASE WHEN o_orderstatus = 'P' THEN '-' ELSE '1+' || o_orderstatus END) AS h FROM orders),
         s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 5) AS BIGINT)) AS a,
                      sum(CAST('0x' || substr(h, 6, 5) AS BIGINT)) AS b,
                      sum(CAST('0x' || substr(h, 11, 5) AS BIGINT)) AS c FROM d)
    SELECT CAST(n AS BIGINT) AS row_count, sha256(
        'o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string:' || n || ':' || a || ':' || b || ':' || c)
        AS data_fingerprint FROM s""")
def dataset_fingerprint_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return dataset_fingerprint(df)


@query("fingerprint_schema", """
    SELECT 'renamed' AS change, true AS differs FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'retyped', true FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'moved boundary', true FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'reordered rows', false FROM orders HAVING count(*) > 0""")
def fingerprint_schema(spark, sf_dir):
    """The same cells under other names or types are other data; the order of rows is not."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    joined = df.select("o_orderkey", "o_custkey", F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("o_orderstatus"),
                       F.substring("o_orderpriority", 2, 99).alias("o_orderpriority"))
    changes = {"renamed": df.withColumnRenamed("o_custkey", "customer"),
               "retyped": df.withColumn("o_custkey", F.col("o_custkey").cast("string")),
               "moved boundary": joined, "reordered rows": df.repartition(7, "o_custkey")}
    base = dataset_fingerprint(df).select(F.col("data_fingerprint").alias("own"))
    parts = [dataset_fingerprint(changed).crossJoin(base).select(  # one row on either side
        F.lit(name).alias("change"), (F.col("data_fingerprint") != F.col("own")).alias("differs"))
        for name, changed in changes.items()]
    return reduce(DataFrame.unionByName, parts)


@query("key_digest", """
    SELECT o_orderkey, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN
           sha256(coalesce(sha256(a), 'NULL') || '|' || coalesce(sha256(b), 'NULL')) END AS digest
    FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS a,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS b FROM orders)""")
def key_digests(spark, sf_dir):
    status = F.nullif("o_orderstatus", F.lit("P"))
    priority = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key_digest(status, priority).alias("digest"))


# --- baselines and drift ---------------------------------------------------------

@query("baseline_snapshot", f"""
    SELECT 'o_orderkey' AS name, 'integer' AS observed_type, count(*) > count(o_orderkey) AS nullable_observed FROM {NULLED}
    UNION ALL SELECT 'o_orderstatus', 'string', count(*) > count(o_orderstatus) FROM {NULLED}
    UNION ALL SELECT 'o_totalprice', 'number', count(*) > count(o_totalprice) FROM {NULLED}""")
def baseline_snapshot(spark, sf_dir):
    return drift.snapshot(profile.profile(nulled_orders(spark, sf_dir), distinct="none"))


def _orders_drift(spark, sf_dir):
    """The approved shape of orders against a later delivery with four kinds of change."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    after = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice", "o_orderdate")
    shots = [drift.snapshot(profile.profile(df, distinct="none")) for df in (before, after)]
    return drift.compare_snapshots(*shots)


DRIFT_SQL = """
    SELECT * FROM (VALUES
      ('added', 'o_orderdate', NULL, 'datetime', 'warning'), ('added', 'o_totalprice', NULL, 'number', 'warning'),
      ('removed', 'o_orderpriority', 'string', NULL, 'error'),
      ('type_changed', 'o_custkey', 'integer', 'string', 'error'))
      v(change_type, "column", "before", "after", severity)
    WHERE (SELECT count(*) FROM orders) > 0
    UNION ALL SELECT 'nullability_changed', 'o_orderstatus', 'false', 'true', 'warning'
    FROM orders HAVING count(*) FILTER (o_orderstatus = 'P') > 0"""


@query("drift_compare", DRIFT_SQL)
def drift_compare(spark, sf_dir):
    return _orders_drift(spark, sf_dir)


@query("drift_findings", f"""
    SELECT substr(sha256('drift.' || change_type || '|' || "column" || '|Column ''' || "column"
                         || ''' differs from the baseline.'), 1, 16) AS finding_id,
           'drift.' || change_type AS rule_id, severity, 'drift' AS category, "column",
           "before" AS expected, "after" AS observed FROM ({DRIFT_SQL})""")
def drift_findings(spark, sf_dir):
    return drift.drift_findings(_orders_drift(spark, sf_dir)).select(
        "finding_id", "rule_id", "severity", "category", "column", "expected", "observed")

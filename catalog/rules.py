"""Column rules, dataset rules and whole validations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalog.base import AS_OF, compact, query, row_rule_sql, table
from tablepact import Contract, validate
from tablepact.functions.coercion import as_number, as_timestamp, named
from tablepact.functions.expressions import arithmetic
from tablepact.operators import findings as fnd
from tablepact.operators import keys, predicates, samples
from tablepact.operators.schema_checks import (
    declared_columns, extra_columns, missing_columns, observed_columns,
)


def contract_of(name, rules=None, dataset_rules=None, **dataset):
    return {"dataset": {"name": name, **dataset}, "rules": rules or {},
            "dataset_rules": dataset_rules or [], "privacy": {"detect_pii": False}}


def check(df, key, rules=None, dataset_rules=None, references=None):
    made = validate(df, contract_of("t", rules, dataset_rules), row_key=key, as_of=AS_OF,
                    references=references)
    return compact(made.findings)


def column_rule(name, rule_id, category, table_name, key, column, rule, violated,
                expression=None, sql_expression=None):
    """Register one column rule on a table, optionally on a derived text column."""
    source = table_name
    if expression is not None:
        source = f"(SELECT {key}, {sql_expression or expression} AS {column} FROM {table_name})"

    @query(name, row_rule_sql(rule_id, category, column, source, violated, key))
    def run(spark, sf_dir):
        df = table(spark, sf_dir, table_name)
        if expression is not None:
            df = df.select(key, F.expr(expression).alias(column))
        return check(df, key, {column: rule})


MIXED = ("CASE o_orderpriority WHEN '1-URGENT' THEN '1d' WHEN '2-HIGH' THEN ' 12 ' "
         "WHEN '3-MEDIUM' THEN '1e3' WHEN '4-NOT SPECIFIED' THEN o_orderstatus "
         "ELSE concat(cast(o_custkey AS {text}), '.5') END")
NUMERIC = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
BOOLEANS = "('true','false','0','1','yes','no','y','n')"
WORDED = "CASE o_orderstatus WHEN 'O' THEN ' Yes' WHEN 'F' THEN 'false' ELSE o_orderpriority END"
UUIDS = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN md5(c_name) "
         "WHEN 'BUILDING' THEN concat('urn:uuid:', md5(c_name)) "
         "WHEN 'MACHINERY' THEN concat('{', substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 24), '}') "
         "WHEN 'HOUSEHOLD' THEN substr(md5(c_name), 1, 31) ELSE c_name END")
MAILS = ("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN concat(lower(c_name), ' @example.com') "
         "WHEN 'MACHINERY' THEN c_name ELSE concat(lower(c_name), '@example.com') END")

column_rule("rule_nullable", "column.nullable", "completeness", "orders", "o_orderkey", "status",
            {"nullable": False}, "status IS NULL", "nullif(o_orderstatus, 'P')")
column_rule("rule_type_integer", "column.type", "validity", "orders", "o_orderkey", "amount",
            {"type": "integer"},
            f"amount IS NOT NULL AND (NOT regexp_matches(amount, '{NUMERIC}') OR "
            "abs(TRY_CAST(trim(amount) AS DOUBLE) - round(TRY_CAST(trim(amount) AS DOUBLE))) > 1e-12)",
            MIXED.format(text="string"), MIXED.format(text="varchar"))
column_rule("rule_type_number", "column.type", "validity", "orders", "o_orderkey", "amount",
            {"type": "number"}, f"NOT regexp_matches(amount, '{NUMERIC}')",
            MIXED.format(text="string"), MIXED.format(text="varchar"))
column_rule("rule_type_boolean", "column.type", "validity", "orders", "o_orderkey", "flag",
            {"type": "boolean"}, f"lower(trim(flag)) NOT IN {BOOLEANS}", WORDED)
column_rule("rule_type_email", "column.type", "validity", "customer", "c_custkey", "mail",
            {"type": "email"}, r"NOT regexp_full_match(mail, '[^\s@]+@[^\s@]+\.[^\s@]+')", MAILS)
column_rule("rule_type_uuid", "column.type", "validity", "customer", "c_custkey", "ref",
            {"type": "uuid"},
            "NOT regexp_full_match(replace(regexp_replace(regexp_replace(ref, 'urn:|uuid:', '', 'g'), "
            "'^[{}]+|[{}]+$', '', 'g'), '-', ''), '[0-9a-fA-F]{32}')", UUIDS)
column_rule("rule_minimum", "column.minimum", "validity", "customer", "c_custkey", "c_acctbal",
            {"minimum": 0}, "c_acctbal < 0")
column_rule("rule_maximum", "column.maximum", "validity", "part", "p_partkey", "p_size",
            {"maximum": 45}, "p_size > 45")
column_rule("rule_min_length", "column.min_length", "validity", "documents", "doc_id", "text",
            {"min_length": 200}, "length(text) < 200")
column_rule("rule_max_length", "column.max_length", "validity", "pages", "page_id", "html",
            {"max_length": 2000}, "length(html) > 2000")
column_rule("rule_pattern", "column.pattern", "validity", "pages", "page_id", "url",
            {"pattern": r"https?://[a-z.]+/[a-z]{2}/\d+"},
            r"NOT regexp_full_match(url, 'https?://[a-z.]+/[a-z]{2}/\d+')")


@query("rule_pattern_double", row_rule_sql(
    "column.pattern", "validity", "wide", "(SELECT o_orderkey, CAST(o_totalprice * 1000 AS DOUBLE) AS wide FROM orders)",
    "NOT (wide BETWEEN 100000000 AND 999999999)", "o_orderkey"))
def rule_pattern_double(spark, sf_dir):
    """Doubles beyond ten million are matched in plain notation, not with an exponent."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 1000).alias("wide"))
    return check(df, "o_orderkey", {"wide": {"pattern": r"\d{9}\.\d+"}})


column_rule("rule_allowed_values", "column.allowed_values", "validity", "orders", "o_orderkey",
            "o_orderstatus", {"allowed_values": ["O", "F"]}, "o_orderstatus NOT IN ('O', 'F')")
column_rule("rule_freshness", "column.maximum_age_hours", "freshness", "orders", "o_orderkey",
            "o_orderdate", {"maximum_age_hours": 48},
            f"o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR")

DATED = """CASE o_orderpriority WHEN '1-URGENT' THEN {us} WHEN '2-HIGH' THEN {packed}
           WHEN '3-MEDIUM' THEN o_orderpriority WHEN '5-LOW' THEN {iso}
           ELSE concat({iso}, 'T', o_orderstatus) END"""
SQL_DATED = DATED.format(us="strftime(o_orderdate, '%m/%d/%Y')", packed="strftime(o_orderdate, '%Y%m%d')",
                         iso="strftime(o_orderdate, '%Y-%m-%d')")
SPARK_DATED = DATED.format(us="date_format(o_orderdate, 'MM/dd/yyyy')",
                           packed="date_format(o_orderdate, 'yyyyMMdd')",
                           iso="date_format(o_orderdate, 'yyyy-MM-dd')")
SQL_PARSED = "try_strptime(day, ['%Y-%m-%d', '%m/%d/%Y', '%Y%m%d'])"
column_rule("rule_type_datetime", "column.type", "validity", "orders", "o_orderkey", "day",
            {"type": "datetime"}, f"{SQL_PARSED} IS NULL", SPARK_DATED, SQL_DATED)

DUPLICATE_TEXTS = "(SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents)"


@query("rule_unique", row_rule_sql("column.unique", "uniqueness", "text", DUPLICATE_TEXTS, "n > 1", "doc_id"))
def rule_unique(spark, sf_dir):
    return check(table(spark, sf_dir, "documents"), "doc_id", {"text": {"unique": True}})


# --- dataset rules ---------------------------------------------------------------

@query("ds_row_count", """
    SELECT 'dataset.row_count.volume' AS rule_id, 'critical' AS severity, 'volume' AS category,
           CAST(NULL AS VARCHAR) AS "column", CAST(0 AS BIGINT) AS affected_rows,
           count(*) || ' rows' AS observed
    FROM lineitem HAVING count(*) > 1000""")
def ds_row_count(spark, sf_dir):
    rule = {"name": "volume", "type": "row_count", "minimum": 1, "maximum": 1000, "severity": "critical"}
    made = validate(table(spark, sf_dir, "lineitem"), contract_of("lineitem", dataset_rules=[rule]))
    return made.findings.select("rule_id", "severity", "category", "column", "affected_rows", "observed")


LINE_TWINS = ("(SELECT l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)")


@query("ds_unique_combination", row_rule_sql(
    "dataset.unique_combination.line_key", "uniqueness", None, LINE_TWINS, "n > 1", "l_partkey"))
def ds_unique_combination(spark, sf_dir):
    rule = {"name": "line_key", "type": "unique_combination", "columns": ["l_orderkey", "l_linenumber"]}
    return check(table(spark, sf_dir, "lineitem"), "l_partkey", dataset_rules=[rule])


STATUSES = "(SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status, o_orderpriority FROM orders)"


def with_null_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"))


@query("ds_null_ratio", row_rule_sql(
    "dataset.null_ratio.status_filled", "completeness", "status", STATUSES, "status IS NULL", "o_orderkey",
    extra=f""", (SELECT format('null ratio {{:.2f}}%', 100.0 * count(*) FILTER (status IS NULL) / count(*))
                 FROM {STATUSES}) AS observed"""))
def ds_null_ratio(spark, sf_dir):
    rule = {"name": "status_filled", "type": "null_ratio", "column": "status", "max_ratio": 0.01}
    made = validate(with_null_status(spark, sf_dir), contract_of("t", dataset_rules=[rule]), row_key="o_orderkey")
    return compact(made.findings, "observed")


@query("ds_conditional_not_null", row_rule_sql(
    "dataset.conditional_not_null.urgent_status", "completeness", "status", STATUSES,
    "o_orderpriority = '1-URGENT' AND status IS NULL", "o_orderkey"))
def ds_conditional_not_null(spark, sf_dir):
    rule = {"name": "urgent_status", "type": "conditional_not_null", "when_column": "o_orderpriority",
            "when_equals": "1-URGENT", "then_column": "status"}
    return check(with_null_status(spark, sf_dir), "o_orderkey", dataset_rules=[rule])


LINE_PRICE = "l_quantity * 1000 * (1 - l_discount) / (1 + l_tax)"


@query("ds_reconciliation_row", row_rule_sql(
    "dataset.aggregate_reconciliation.line_price", "reconciliation", "l_extendedprice",
    "lineitem",
    f"abs(l_extendedprice - ({LINE_PRICE})) > 25000", "l_orderkey"))
def ds_reconciliation_row(spark, sf_dir):
    rule = {"name": "line_price", "type": "aggregate_reconciliation", "left_column": "l_extendedprice",
            "right_expression": LINE_PRICE, "tolerance": 25000}
    return check(table(spark, sf_dir, "lineitem"), "l_orderkey", dataset_rules=[rule])


@query("ds_reconciliation_grouped", """
    WITH d AS (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY 1),
         o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS amount
               FROM orders WHERE o_orderkey % 7 > 0)
    SELECT coalesce(o_orderkey, l_orderkey) AS key, round(amount, 2) AS header_total,
           round(coalesce(total, 0), 2) AS detail_total, CAST(coalesce(n, 0) AS BIGINT) AS detail_rows
    FROM o FULL JOIN d ON l_orderkey = o_orderkey
    WHERE abs(coalesce(amount, 0) - coalesce(total, 0)) > 0.01""")
def ds_reconciliation_grouped(spark, sf_dir):
    """Headers are missing for some details, and amounts for some headers."""
    headers = table(spark, sf_dir, "orders").where("o_orderkey % 7 > 0").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")))
    off = keys.group_reconciliation(
        headers, "o_orderkey", "o_totalprice",
        table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", 0.01)
    return off.select("key", F.round("header_total", 2).alias("header_total"),
                      F.round("detail_total", 2).alias("detail_total"), "detail_rows")


def _reference_sql(name, column, source, key, target, target_column):
    return row_rule_sql(f"dataset.reference_exists.{name}", "referential_integrity", column, source,
                        f"{column} NOT IN (SELECT {target_column} FROM {target})", key)


@query("ds_reference_exists", " UNION ALL ".join([
    _reference_sql("labelled", "doc_id", "documents", "doc_id", "labels", "doc_id")]))
def ds_reference_exists(spark, sf_dir):
    rules = [{"name": "labelled", "type": "reference_exists", "column": "doc_id",
              "reference_dataset": "labels", "reference_column": "doc_id"}]
    return check(table(spark, sf_dir, "documents"), "doc_id", dataset_rules=rules,
                 references={"labels": table(spark, sf_dir, "labels")})


@query("ds_reference_mixed_types", _reference_sql(
    "customers", "o_custkey", "orders", "o_orderkey", "(SELECT * FROM customer WHERE c_custkey % 3 > 0)", "c_custkey"))
def ds_reference_mixed_types(spark, sf_dir):
    """Keys as doubles against keys as text meet by value."""
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("double"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".0").otherwise("")).alias("c_custkey"))
    rules = [{"name": "customers", "type": "reference_exists", "column": "o_custkey",
              "reference_dataset": "customers", "reference_column": "c_custkey"}]
    return check(orders, "o_orderkey", dataset_rules=rules, references={"customers": known})


@query("ds_reference_exists_wide", _reference_sql(
    "has_lines", "o_orderkey", "orders", "o_orderkey", "lineitem", "l_orderkey"))
def ds_reference_exists_wide(spark, sf_dir):
    """The same rule on the path for references too large to broadcast."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    absent = keys.missing_references(orders, "o_orderkey", lines, "l_orderkey", "o_orderkey",
                                     broadcast_bytes=0)
    rows = keys.reference_samples(orders, "o_orderkey", absent, lines, "l_orderkey", "o_orderkey")
    text = F.array_join(F.col("sample_rows").cast("array<string>"), ",")
    found = absent.agg(F.sum("n").alias("affected_rows")).where("affected_rows > 0")
    return found.withColumn("sample_rows", rows.select(text).scalar()).select(
        F.lit("dataset.reference_exists.has_lines").alias("rule_id"), F.lit("error").alias("severity"),
        F.lit("referential_integrity").alias("category"), F.lit("o_orderkey").alias("column"),
        "affected_rows", "sample_rows")


@query("expr_arithmetic", """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
           round(l_extendedprice * (1 - l_discount) + l_tax / nullif(l_discount, 0) - -l_quantity, 4) AS value
    FROM lineitem""")
def expr_arithmetic(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    value = arithmetic("l_extendedprice * (1 - l_discount) + l_tax / l_discount - -l_quantity",
                       lambda c: as_number(named(c), df.schema[c].dataType))
    return df.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                     F.round(value, 4).alias("value"))


@query("fn_try_numeric", f"""
    SELECT o_orderkey, amount, CASE WHEN regexp_matches(amount, '{NUMERIC}')
           THEN TRY_CAST(trim(amount) AS DOUBLE) END AS value
    FROM (SELECT o_orderkey, {MIXED.format(text='varchar')} AS amount FROM orders)""")
def fn_try_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(MIXED.format(text="string")).alias("amount"))
    return df.withColumn("value", as_number(F.col("amount"), T.StringType()))


@query("fn_try_timestamp", f"""
    SELECT o_orderkey, day, strftime({SQL_PARSED}, '%Y-%m-%d %H:%M:%S') AS value
    FROM (SELECT o_orderkey, {SQL_DATED} AS day FROM orders)""")
def fn_try_timestamp(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SPARK_DATED).alias("day"))
    parsed = as_timestamp(F.col("day"), T.StringType())
    return df.withColumn("value", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"))


# --- schema checks ---------------------------------------------------------------

CATALOGUE = ("orders", "customer", "supplier", "labels")
DECLARED = [
    contract_of("orders", required_columns=["o_orderkey", "o_custkey", "o_clerk"], allow_extra_columns=False),
    contract_of("customer", {"c_custkey": {}, "c_phone": {}}, required_columns=["c_name"]),
    contract_of("supplier", {"s_suppkey": {}}, allow_extra_columns=False, extra_columns_severity="error"),
]


def _catalogue(spark, sf_dir):
    observed = observed_columns({t: table(spark, sf_dir, t) for t in CATALOGUE})
    return declared_columns(spark, [Contract.from_dict(c) for c in DECLARED]), observed


@query("schema_required_missing", """
    SELECT d.dataset, d."column", CAST(n AS BIGINT) AS row_count
    FROM (VALUES ('orders', 'o_clerk'), ('customer', 'c_phone')) d(dataset, "column")
    JOIN (SELECT 'orders' AS dataset, count(*) AS n FROM orders
          UNION ALL SELECT 'customer', count(*) FROM customer) USING (dataset)""")
def schema_required_missing(spark, sf_dir):
    declared, observed = _catalogue(spark, sf_dir)
    sizes = observed.groupBy("dataset").agg(F.max("row_count").alias("row_count"))
    return missing_columns(declared, observed).join(sizes, "dataset").select("dataset", "column", "row_count")


@query("schema_extra_columns", """
    SELECT * FROM (
      SELECT 'orders' AS dataset, 'warning' AS severity, unnest(['o_orderstatus', 'o_totalprice',
             'o_orderdate', 'o_orderpriority']) AS "column",
             CAST(unnest([count(o_orderstatus), count(o_totalprice), count(o_orderdate),
                          count(o_orderpriority)]) AS BIGINT) AS filled FROM orders
      UNION ALL
      SELECT 'supplier', 'error', unnest(['s_name', 's_nationkey', 's_acctbal']),
             CAST(unnest([count(s_name), count(s_nationkey), count(s_acctbal)]) AS BIGINT) FROM supplier)""")
def schema_extra_columns(spark, sf_dir):
    declared, observed = _catalogue(spark, sf_dir)
    return extra_columns(declared, observed).select("dataset", "severity", "column", "filled")


# --- whole validations -----------------------------------------------------------

ORDERS = {
    "dataset": {"name": "orders", "contract_id": "orders-core", "owner": "Sales",
                "required_columns": ["o_orderkey", "o_clerk"]},
    "rules": {
        "o_orderkey": {"type": "integer", "nullable": False, "unique": True, "severity": "critical"},
        "o_custkey": {"type": "integer", "nullable": False, "minimum": 1},
        "o_totalprice": {"type": "number", "minimum": 50000, "maximum": 450000, "severity": "warning"},
        "o_orderstatus": {"type": "string", "allowed_values": ["O", "F"], "max_length": 1},
        "o_orderdate": {"type": "datetime", "maximum_age_hours": 48},
        "o_orderpriority": {"pattern": r"\d-[A-Z]+", "severity": "info"},
    },
    "dataset_rules": [
        {"name": "volume", "type": "row_count", "minimum": 1},
        {"name": "customer_day", "type": "unique_combination", "columns": ["o_custkey", "o_orderdate"]},
        {"name": "has_lines", "type": "reference_exists", "column": "o_orderkey",
         "reference_dataset": "lineitem", "reference_column": "l_orderkey"},
        {"name": "price_formula", "type": "aggregate_reconciliation", "left_column": "o_totalprice",
         "right_expression": "o_custkey * 100 + o_orderkey", "tolerance": 100000},
    ],
    "privacy": {"detect_pii": False},
}
_TWINS = "(SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders)"
ROW_SQL = [
    row_rule_sql("column.minimum", "validity", "o_custkey", "orders", "o_custkey < 1", "o_orderkey"),
    row_rule_sql("column.minimum", "validity", "o_totalprice", "orders", "o_totalprice < 50000",
                 "o_orderkey", "warning"),
    row_rule_sql("column.maximum", "validity", "o_totalprice", "orders", "o_totalprice > 450000",
                 "o_orderkey", "warning"),
    row_rule_sql("column.allowed_values", "validity", "o_orderstatus", "orders",
                 "o_orderstatus NOT IN ('O', 'F')", "o_orderkey"),
    row_rule_sql("column.maximum_age_hours", "freshness", "o_orderdate", "orders",
                 f"o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR", "o_orderkey"),
    row_rule_sql("column.pattern", "validity", "o_orderpriority", "orders",
                 r"NOT regexp_full_match(o_orderpriority, '\d-[A-Z]+')", "o_orderkey", "info"),
    row_rule_sql("dataset.aggregate_reconciliation.price_formula", "reconciliation", "o_totalprice",
                 "orders", "abs(o_totalprice - (o_custkey * 100.0 + o_orderkey)) > 100000", "o_orderkey"),
]
KEY_SQL = [
    row_rule_sql("dataset.unique_combination.customer_day", "uniqueness", None, _TWINS, "n > 1", "o_orderkey"),
    _reference_sql("has_lines", "o_orderkey", "orders", "o_orderkey", "lineitem", "l_orderkey"),
]
SCHEMA_SQL = """SELECT 'schema.required_column' AS rule_id, 'critical' AS severity, 'schema' AS category,
                'o_clerk' AS "column", CAST(0 AS BIGINT) AS affected_rows, '' AS sample_rows"""
ALL_SQL = " UNION ALL ".join([*ROW_SQL, *KEY_SQL, SCHEMA_SQL])


def orders_validation(spark, sf_dir, contract=ORDERS, row_key="o_orderkey"):
    return validate(table(spark, sf_dir, "orders"), contract, row_key=row_key, as_of=AS_OF,
                    references={"lineitem": table(spark, sf_dir, "lineitem")}, run_id="orders")


@query("validate_orders", "SELECT * EXCLUDE (sample_rows) FROM (" + " UNION ALL ".join(ROW_SQL) + ")")
def validate_orders(spark, sf_dir):
    """All row rules of a contract: one scan, one aggregate."""
    df = table(spark, sf_dir, "orders")
    checks = predicates.row_checks(df.schema, Contract.from_dict(ORDERS), AS_OF)
    return predicates.row_findings(df, checks).select(
        "rule_id", "severity", "category", "column", "affected_rows")


@query("validate_all_findings", ALL_SQL)
def validate_all_findings(spark, sf_dir):
    return compact(orders_validation(spark, sf_dir).findings)


@query("finding_ids", f"""
    SELECT rule_id, "column", affected_rows, message,
           substr(sha256(rule_id || '|' || coalesce("column", '') || '|' || message), 1, 16) AS finding_id
    FROM (SELECT *, CASE rule_id
            WHEN 'column.minimum' THEN 'Column ''' || "column" || ''': ' || affected_rows || ' value(s) below '
                 || CASE "column" WHEN 'o_custkey' THEN '1.' ELSE '50000.' END
            WHEN 'column.maximum' THEN 'Column ''o_totalprice'': ' || affected_rows || ' value(s) above 450000.'
            WHEN 'column.allowed_values' THEN 'Column ''o_orderstatus'': ' || affected_rows
                 || ' value(s) are not on the approved list.'
            WHEN 'column.maximum_age_hours' THEN 'Column ''o_orderdate'': ' || affected_rows
                 || ' row(s) older than 48 hour(s).'
            WHEN 'column.pattern' THEN 'Column ''o_orderpriority'': ' || affected_rows
                 || ' value(s) do not match the pattern.'
            WHEN 'dataset.unique_combination.customer_day' THEN affected_rows
                 || ' row(s) share their combination of 2 columns.'
            END AS message FROM ({ALL_SQL})) WHERE message IS NOT NULL""")
def finding_ids(spark, sf_dir):
    found = orders_validation(spark, sf_dir, row_key=None).findings
    return found.where(F.col("rule_id").startswith("column.")
                       | (F.col("rule_id") == "dataset.unique_combination.customer_day")).select(
        "rule_id", "column", "affected_rows", "message", "finding_id")


RANKS = "CASE severity WHEN 'info' THEN 10 WHEN 'warning' THEN 20 WHEN 'error' THEN 30 ELSE 40 END"


@query("findings_ranked", f"""
    SELECT CAST(row_number() OVER (ORDER BY {RANKS} DESC, category, rule_id, coalesce("column", '')) AS BIGINT)
           AS position, rule_id, severity, category, "column", affected_rows
    FROM ({ALL_SQL})""")
def findings_ranked(spark, sf_dir):
    found = orders_validation(spark, sf_dir, row_key=None).findings
    nth = F.row_number().over(Window.orderBy(*fnd.finding_order()))
    return fnd.rank_findings(found.select(
        nth.cast("bigint").alias("position"), *found.columns)).select(
        "position", "rule_id", "severity", "category", "column", "affected_rows")


@query("findings_capped", f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY {RANKS} DESC, category, rule_id, coalesce("column", '')) AS nth,
                      count(*) OVER () AS total FROM ({ALL_SQL}))
    SELECT CASE WHEN cut THEN 'runtime.finding_limit' ELSE rule_id END AS rule_id,
           CASE WHEN cut THEN 'critical' ELSE severity END AS severity,
           CASE WHEN cut THEN 'runtime' ELSE category END AS category,
           CASE WHEN cut THEN NULL ELSE "column" END AS "column",
           CASE WHEN cut THEN 0 ELSE affected_rows END AS affected_rows,
           CASE WHEN cut THEN total || ' findings' END AS observed
    FROM (SELECT *, nth = 6 AND total > 6 AS cut FROM r) WHERE nth <= 6""")
def findings_capped(spark, sf_dir):
    found = fnd.cap_findings(orders_validation(spark, sf_dir, row_key=None).findings, 6)
    cut = F.col("rule_id") == "runtime.finding_limit"
    return found.select("rule_id", "severity", "category", "column", "affected_rows",
                        F.when(cut, F.col("observed")).alias("observed"))


@query("summary_by_severity", f"""
    SELECT CAST(count(*) AS BIGINT) AS findings_total,
           CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS info,
           CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings,
           CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors,
           CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical,
           count(*) FILTER (severity IN ('error', 'critical')) = 0 AS passed,
           'error' AS fail_on, CASE WHEN count(*) FILTER (severity IN ('error', 'critical')) = 0
                               THEN 'passed' ELSE 'failed' END AS status
    FROM ({ALL_SQL})""")
def summary_by_severity(spark, sf_dir):
    return orders_validation(spark, sf_dir, row_key=None).summary()


@query("summary_by_category", f"""
    SELECT category, severity, CAST(count(*) AS BIGINT) AS findings,
           CAST(sum(affected_rows) AS BIGINT) AS affected_rows
    FROM ({ALL_SQL}) GROUP BY category, severity""")
def summary_by_category(spark, sf_dir):
    return fnd.summarize_by_category(orders_validation(spark, sf_dir, row_key=None).findings)


@query("sample_violations", """
    SELECT rule_id, "column", k AS row_key FROM (
      SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY k) AS nth FROM (
        SELECT 'column.minimum' AS rule_id, 'o_totalprice' AS "column", o_orderkey AS k
        FROM orders WHERE o_totalprice < 50000
        UNION ALL SELECT 'column.allowed_values', 'o_orderstatus', o_orderkey
        FROM orders WHERE o_orderstatus NOT IN ('O', 'F')))
    WHERE nth <= 10""")
def sample_violations(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rules = {"o_totalprice": {"minimum": 50000}, "o_orderstatus": {"allowed_values": ["O", "F"]}}
    checks = predicates.row_checks(df.schema, Contract.from_dict(contract_of("orders", rules)))
    broken = predicates.violating_rows(df, checks, ["o_orderkey"])
    kept = samples.smallest_per_group(broken, ["rule_id", "column"], "o_orderkey", 10)
    return kept.select("rule_id", "column", F.col("o_orderkey").alias("row_key"))


@query("sample_duplicates", """
    SELECT doc_id AS row_key FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents)
    WHERE n > 1 ORDER BY doc_id LIMIT 10""")
def sample_duplicates(spark, sf_dir):
    found = keys.duplicate_samples(table(spark, sf_dir, "documents"), ["text"], "doc_id")
    return found.select(F.explode("sample_rows").alias("row_key"))


@query("findings_merge", f"""
    WITH b AS (
      SELECT date_trunc('month', o_orderdate) AS m, 'column.minimum' AS rule_id, 'o_totalprice' AS "column",
             o_orderkey AS k FROM orders WHERE o_totalprice < 50000
      UNION ALL
      SELECT date_trunc('month', o_orderdate), 'column.allowed_values', 'o_orderstatus', o_orderkey
      FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
    SELECT rule_id, "column", CAST(count(*) AS BIGINT) AS affected_rows,
           CASE WHEN count(DISTINCT m) > 1 THEN count(*) || ' affected rows' END AS observed
    FROM b GROUP BY rule_id, "column" """)
def findings_merge(spark, sf_dir):
    """Findings of monthly batches merged into one per rule."""
    df = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    rules = {"o_totalprice": {"minimum": 50000}, "o_orderstatus": {"allowed_values": ["O", "F"]}}
    checks = predicates.row_checks(df.schema, Contract.from_dict(contract_of("orders", rules)))
    batches = predicates.row_findings(df, checks, by=["month"])
    return fnd.merge_findings(batches).select("rule_id", "column", "affected_rows", "observed")


@query("sample_null_row_keys", """
    SELECT 'column.maximum' AS rule_id, k.n AS affected_rows, k.rows AS sample_rows FROM (
        SELECT CAST(count(*) AS BIGINT) AS n, (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM (
            SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_custkey % 2 > 0 ORDER BY o_orderkey LIMIT 10)) AS rows
        FROM orders WHERE o_custkey > 10) k WHERE n > 0
    UNION ALL
    SELECT 'column.unique', k.n, k.rows FROM (
        SELECT CAST(count(*) AS BIGINT) AS n, (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM (
            SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
            WHERE c > 1 AND o_custkey % 2 > 0 ORDER BY o_orderkey LIMIT 10)) AS rows
        FROM (SELECT count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE c > 1) k WHERE n > 0""")
def sample_null_row_keys(spark, sf_dir):
    """Rows without a row key are counted, but examples are rows that can be named."""
    df = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 2 > 0, F.col("o_orderkey")).alias("row"), "o_custkey")
    return check(df, "row", {"o_custkey": {"maximum": 10, "unique": True}}).select("rule_id", "affected_rows", "sample_rows")

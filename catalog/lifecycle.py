"""The contract registry: inventory, audit, diff and ODCS documents.

The registries are derived from the tables: every customer's orders before and after a
date give two versions of that customer's contract, documents give contracts to audit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from tablepact.plans import registry

SPLIT = "1998-06-01 00:00:00"


def _null(kind):
    return F.lit(None).cast(kind)


def customer_registry(spark, sf_dir, newer: bool):
    """(headers, columns, rules): one contract per customer from their orders of one period."""
    at, split = F.col("o_orderdate"), F.lit(SPLIT).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").where(at >= split if newer else at < split)
    facts = orders.groupBy(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("contract")).agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
        F.array_sort(F.collect_set(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))).alias("statuses"),
        F.max("o_orderpriority").alias("priority"), F.count(F.lit(1)).alias("n"))
    version = F.lit("2.0" if newer else "1.0")
    low_volume = F.col("n") < 5
    headers = facts.select(
        "contract", version.alias("version"), F.lit("orders").alias("dataset_name"),
        F.when(~low_volume, F.col("contract")).alias("contract_id"),
        F.col("priority").alias("description"), F.lit("Sales").alias("owner"),
        F.when(low_volume, F.array(F.lit("price"))).otherwise(F.array(F.lit("price"), F.lit("status")))
        .alias("required_columns"))

    def column(name, **given):
        values = dict(
            type=F.lit("any"), nullable=F.lit(True), unique=F.lit(False), strict_type=F.lit(False),
            minimum=_null("double"), maximum=_null("double"), min_length=_null("bigint"),
            max_length=_null("bigint"), pattern=_null("string"), allowed_values=_null("array<string>"),
            maximum_age_hours=_null("double"), severity=F.lit("error"), description=_null("string"),
            classification=_null("string"))
        values.update(given)
        return F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in values.items()])

    rows = F.array_compact(F.array(
        column("price", type=F.when(F.col("n") > 8, "integer").otherwise("number"),
               nullable=F.col("n") % 2 == 0, unique=F.col("n") > 6,
               minimum=F.col("low"), maximum=F.when(F.col("n") > 3, F.col("high")),
               maximum_age_hours=F.when(F.col("n") > 4, F.col("n") * 1.0), description=F.col("priority")),
        F.when(~low_volume, column("status", allowed_values=F.col("statuses")))))
    columns = facts.select("contract", version.alias("version"), F.explode(rows).alias("r")) \
        .select("contract", "version", "r.*")

    def rule(i, name, kind, **given):
        values = {f.name: _null(f.dataType) for f in registry.RULE_SCHEMA.fields[5:]}
        values["tolerance"] = F.lit(0.0)
        values.update(severity=F.lit("error"), **given)
        return F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(name).cast("string").alias("name"),
                        F.lit(kind).alias("type"), *[v.alias(k) for k, v in values.items()])

    dataset_rules = F.array_compact(F.array(
        rule(1, "volume", "row_count", minimum=F.lit(1.0), maximum=F.col("n") * 1.0),
        F.when(F.col("n") > 5, rule(2, None, "null_ratio", column=F.lit("status"), max_ratio=F.lit(0.1)))))
    rules = facts.select("contract", version.alias("version"), F.explode(dataset_rules).alias("r")) \
        .select("contract", "version", "r.*")
    return headers, columns, rules


FACTS = """SELECT 'cust-' || o_custkey AS contract, min(o_totalprice) AS low, max(o_totalprice) AS high,
    list_sort(list_distinct(list(o_orderstatus))) AS statuses, max(o_orderpriority) AS priority, count(*) AS n
    FROM orders WHERE o_orderdate {op} TIMESTAMP '""" + SPLIT + """' GROUP BY o_custkey"""


def _inventory_sql(op: str, version: str) -> str:
    return f"""
    WITH f AS ({FACTS.format(op=op)})
    SELECT contract, '{version}' AS version, unnest(list_filter([
        CASE WHEN n % 2 = 1 THEN 'column.nullable:price' END, 'column.type:price',
        CASE WHEN n > 6 THEN 'column.unique:price' END, 'column.minimum:price',
        CASE WHEN n > 3 THEN 'column.maximum:price' END,
        CASE WHEN n > 4 THEN 'column.maximum_age_hours:price' END,
        CASE WHEN n >= 5 THEN 'column.allowed_values:status' END, 'dataset.row_count:volume',
        CASE WHEN n > 5 THEN 'dataset.null_ratio:dataset_rule_2' END], lambda x: x IS NOT NULL)) AS rule_id
    FROM f"""


@query("contract_rule_inventory", _inventory_sql(">=", "2.0"))
def contract_rule_inventory(spark, sf_dir):
    _, columns, rules = customer_registry(spark, sf_dir, newer=True)
    return registry.rule_inventory(columns, rules)


@query("contract_rule_inventory_all", f"SELECT * FROM ({_inventory_sql('<', '1.0')}) UNION ALL SELECT * FROM ({_inventory_sql('>=', '2.0')})")
def contract_rule_inventory_all(spark, sf_dir):
    """The rules of both registries: every order takes part."""
    older, newer = customer_registry(spark, sf_dir, False), customer_registry(spark, sf_dir, True)
    return registry.rule_inventory(older[1].unionByName(newer[1]), older[2].unionByName(newer[2]))


CHANGES = f"""
    WITH o AS ({FACTS.format(op='<')}), n AS ({FACTS.format(op='>=')}),
    b AS (SELECT contract, o.low AS ol, n.low AS nl, o.high AS oh, n.high AS nh, o.statuses AS os, n.statuses AS ns,
                 o.priority AS op, n.priority AS np, o.n AS k, n.n AS m FROM o JOIN n USING (contract)),
    every AS (SELECT contract, o.n AS k, n.n AS m FROM o FULL JOIN n USING (contract)),
    c AS (
      SELECT contract, 'dataset.contract_id' AS path, 'potentially_breaking' AS classification FROM b WHERE (k < 5) <> (m < 5)
      UNION ALL SELECT contract, 'dataset.description', 'documentation_only' FROM b WHERE op <> np
      UNION ALL SELECT contract, 'dataset.required_columns.status', 'breaking' FROM b WHERE k < 5 AND m >= 5
      UNION ALL SELECT contract, 'dataset.required_columns.status', 'nonbreaking' FROM b WHERE k >= 5 AND m < 5
      UNION ALL SELECT contract, 'rules.price', CASE WHEN k IS NULL THEN 'breaking' ELSE 'nonbreaking' END
                FROM every WHERE k IS NULL OR m IS NULL
      UNION ALL SELECT contract, 'rules.status', CASE WHEN coalesce(k, 0) < 5 THEN 'breaking' ELSE 'nonbreaking' END
                FROM every WHERE (coalesce(k, 0) >= 5) <> (coalesce(m, 0) >= 5)
      UNION ALL SELECT contract, 'rules.price.type', 'breaking' FROM b WHERE (k > 8) <> (m > 8)
      UNION ALL SELECT contract, 'rules.price.nullable', CASE WHEN m % 2 = 1 THEN 'breaking' ELSE 'nonbreaking' END
                FROM b WHERE k % 2 <> m % 2
      UNION ALL SELECT contract, 'rules.price.unique', CASE WHEN m > 6 THEN 'breaking' ELSE 'nonbreaking' END
                FROM b WHERE (k > 6) <> (m > 6)
      UNION ALL SELECT contract, 'rules.price.minimum', CASE WHEN nl > ol THEN 'breaking' ELSE 'nonbreaking' END
                FROM b WHERE nl <> ol
      UNION ALL SELECT contract, 'rules.price.maximum',
                CASE WHEN m > 3 AND (k <= 3 OR nh < oh) THEN 'breaking' ELSE 'nonbreaking' END
                FROM b WHERE CASE WHEN k > 3 THEN oh END IS DISTINCT FROM CASE WHEN m > 3 THEN nh END
      UNION ALL SELECT contract, 'rules.price.maximum_age_hours',
                CASE WHEN m > 4 AND (k <= 4 OR m < k) THEN 'breaking' ELSE 'nonbreaking' END
                FROM b WHERE CASE WHEN k > 4 THEN k END IS DISTINCT FROM CASE WHEN m > 4 THEN m END
      UNION ALL SELECT contract, 'rules.price.description', 'documentation_only' FROM b WHERE op <> np
      UNION ALL SELECT contract, 'rules.status.allowed_values',
                CASE WHEN len(list_intersect(ns, os)) = len(ns) THEN 'breaking' ELSE 'potentially_breaking' END
                FROM b WHERE k >= 5 AND m >= 5 AND ns <> os
      UNION ALL SELECT contract, 'dataset_rules.volume',
                CASE WHEN m IS NULL THEN 'nonbreaking' ELSE 'potentially_breaking' END
                FROM every WHERE k IS DISTINCT FROM m
      UNION ALL SELECT contract, 'dataset_rules.unnamed:2:null_ratio',
                CASE WHEN coalesce(m, 0) > 5 THEN 'potentially_breaking' ELSE 'nonbreaking' END
                FROM every WHERE (coalesce(k, 0) > 5) <> (coalesce(m, 0) > 5))"""


@query("contract_diff", CHANGES + " SELECT * FROM c")
def contract_diff(spark, sf_dir):
    changes = registry.diff_contracts(
        customer_registry(spark, sf_dir, False), customer_registry(spark, sf_dir, True))
    return changes.select("contract", "path", "classification")


@query("contract_diff_summary", CHANGES + """,
    r AS (SELECT contract, max(CASE classification WHEN 'documentation_only' THEN 10 WHEN 'nonbreaking' THEN 20
                 WHEN 'potentially_breaking' THEN 30 ELSE 40 END) AS heaviest, count(*) AS k FROM c GROUP BY 1)
    SELECT n.contract, coalesce(CASE heaviest WHEN 10 THEN 'documentation_only' WHEN 20 THEN 'nonbreaking'
           WHEN 30 THEN 'potentially_breaking' WHEN 40 THEN 'breaking' END, 'none') AS classification,
           CAST(coalesce(k, 0) AS BIGINT) AS change_count
    FROM n LEFT JOIN r USING (contract)""")
def contract_diff_summary(spark, sf_dir):
    older, newer = customer_registry(spark, sf_dir, False), customer_registry(spark, sf_dir, True)
    return registry.diff_summary(registry.diff_contracts(older, newer), newer[0])


@query("contract_diff_summary_all", CHANGES + """,
    r AS (SELECT contract, max(CASE classification WHEN 'documentation_only' THEN 10 WHEN 'nonbreaking' THEN 20
                 WHEN 'potentially_breaking' THEN 30 ELSE 40 END) AS heaviest, count(*) AS k FROM c GROUP BY 1)
    SELECT contract, coalesce(CASE heaviest WHEN 10 THEN 'documentation_only' WHEN 20 THEN 'nonbreaking'
           WHEN 30 THEN 'potentially_breaking' WHEN 40 THEN 'breaking' END, 'none') AS classification,
           CAST(coalesce(r.k, 0) AS BIGINT) AS change_count
    FROM every LEFT JOIN r USING (contract)""")
def contract_diff_summary_all(spark, sf_dir):
    """A row for every contract of either registry."""
    older, newer = customer_registry(spark, sf_dir, False), customer_registry(spark, sf_dir, True)
    return registry.diff_summary(registry.diff_contracts(older, newer), older[0], newer[0])


def document_registry(spark, sf_dir):
    """One contract per document, with texts as patterns and lengths as bounds."""
    docs = table(spark, sf_dir, "documents")
    contract, version = F.col("doc_id").cast("string").alias("contract"), F.lit("1.0").alias("version")
    headers = docs.select(
        contract, version, F.col("lang").alias("dataset_name"),
        F.nullif("source", F.lit("web")).alias("contract_id"),
        F.nullif("lang", F.lit("en")).alias("description"), F.nullif("lang", F.lit("fr")).alias("owner"),
        F.when(F.col("lang") != "de", F.array("source")).alias("required_columns"))
    columns = docs.select(
        contract, version, F.col("lang").alias("column"), F.col("text").alias("pattern"),
        F.col("n_chars").alias("min_length"), F.lit(1000).cast("bigint").alias("max_length"),
        F.col("n_chars").cast("double").alias("minimum"), _null("double").alias("maximum"),
        _null("double").alias("maximum_age_hours"), F.lit("error").alias("severity"))
    return headers, columns


def line_rules(spark, sf_dir):
    """One contract per order, with a rule per line item."""
    values = {f.name: _null(f.dataType) for f in registry.RULE_SCHEMA.fields[5:]}
    values.update(column=F.lit("l_tax"), max_ratio=F.col("l_quantity") / 40, tolerance=F.lit(0.0),
                  severity=F.lit("error"), reference_dataset=F.when(F.col("l_tax") == 0, "/data/x.csv"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("contract"), F.lit("1.0").alias("version"),
        F.col("l_linenumber").cast("bigint").alias("ordinal"),
        F.nullif("l_returnflag", F.lit("N")).alias("name"), F.lit("null_ratio").alias("type"),
        *[v.alias(k) for k, v in values.items()])


DUPLICATED = """SELECT CAST(l_orderkey AS VARCHAR) AS contract, '1.0' AS version,
    coalesce(nullif(l_returnflag, 'N'), 'dataset_rule_' || l_linenumber) AS rule_name,
    CAST(count(*) AS BIGINT) AS uses FROM lineitem GROUP BY ALL HAVING count(*) > 1"""


@query("contract_duplicate_rules", DUPLICATED)
def contract_duplicate_rules(spark, sf_dir):
    return registry.duplicate_rule_names(line_rules(spark, sf_dir))


@query("contract_audit", f"""
    SELECT level, issue, CAST(count(*) AS BIGINT) AS issues FROM (
      SELECT 'warning' AS level, 'owner is not declared' AS issue FROM documents WHERE lang = 'fr'
      UNION ALL SELECT 'warning', 'contract_id is not declared' FROM documents WHERE source = 'web'
      UNION ALL SELECT 'warning', 'description is not declared' FROM documents WHERE lang = 'en'
      UNION ALL SELECT 'warning', 'no required columns' FROM documents WHERE lang = 'de'
      UNION ALL SELECT 'error', 'pattern too long' FROM documents WHERE length(text) > 512
      UNION ALL SELECT 'error', 'min_length above max_length' FROM documents WHERE n_chars > 1000
      UNION ALL SELECT 'error', 'max_ratio outside 0..1' FROM lineitem WHERE l_quantity > 40
      UNION ALL SELECT 'error', 'reference path is absolute' FROM lineitem WHERE l_tax = 0
      UNION ALL SELECT 'error', 'duplicate dataset rule name' FROM ({DUPLICATED})) GROUP BY level, issue""")
def contract_audit(spark, sf_dir):
    headers, columns = document_registry(spark, sf_dir)
    issues = registry.audit(headers, columns, line_rules(spark, sf_dir))
    return issues.groupBy("level", "issue").agg(F.count(F.lit(1)).alias("issues"))


@query("contract_audit_verdict", """
    SELECT CAST(doc_id AS VARCHAR) AS contract, CAST(e AS BIGINT) AS errors, CAST(w AS BIGINT) AS warnings, e = 0 AS passed
    FROM (SELECT doc_id, (length(text) > 512)::INT + (n_chars > 1000)::INT AS e,
                 (lang = 'fr')::INT + (source = 'web')::INT + (lang = 'en')::INT + (lang = 'de')::INT AS w FROM documents)""")
def contract_audit_verdict(spark, sf_dir):
    headers, columns = document_registry(spark, sf_dir)
    no_rules = spark.createDataFrame([], registry.RULE_SCHEMA)
    return registry.audit_verdict(registry.audit(headers, columns, no_rules), headers).drop("version")


def odcs_documents(spark, sf_dir):
    """An ODCS JSON document per part: its type, size and price decide what it demands."""
    def quality(metric, **extra):
        return F.struct(F.lit(metric).alias("metric"), *[v.alias(k) for k, v in extra.items()])

    big = F.col("p_size") > 25
    declared = F.when(big, "Decimal(10,2)").when(F.col("p_type") == "ECONOMY", "varchar") \
        .when(F.col("p_type") == "STANDARD", "timestamp").otherwise(F.col("p_type"))
    prop_a = F.struct(
        F.lit("p_name").alias("name"), declared.alias("physicalType"), big.alias("required"),
        F.lit(False).alias("unique"), (F.col("p_size") == 1).alias("primaryKey"),
        F.array(
            quality("nullValues", mustBe=(F.col("p_size") % 3).cast("double"), severity=F.lit("Critical"),
                    mustBeGreaterThan=_null("double")),
            quality("duplicates", mustBe=(F.col("p_size") % 5).cast("double"), severity=F.lit("bogus"),
                    mustBeGreaterThan=_null("double"))).alias("quality"))
    prop_b = F.struct(
        F.lit("ignored").alias("name"), F.lit("int").alias("physicalType"), F.lit(False).alias("required"),
        F.lit(True).alias("unique"), F.lit(False).alias("primaryKey"),
        _null("array<struct<metric:string,mustBe:double,severity:string,mustBeGreaterThan:double>>").alias("quality"))
    rows = F.array(quality("rowCount", mustBeGreaterThan=F.col("p_size").cast("double"),
                           mustBeLessOrEqualTo=F.when(big, F.col("p_retailprice")), severity=F.lit("Warning")))
    obj = F.struct(F.lit("parts").alias("physicalName"), F.col("p_brand").alias("description"),
                   F.array(prop_a, prop_b).alias("properties"), rows.alias("quality"))
    team = F.struct(F.lit("crew").alias("name"), F.array(F.struct(
        F.col("p_brand").alias("username"), F.when(big, "Owner").otherwise("Member").alias("role"))).alias("members"))
    doc = F.to_json(F.struct(F.lit("v3.1.0").alias("apiVersion"), F.lit("DataContract").alias("kind"),
                             team.alias("team"), F.array(obj).alias("schema")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), doc.alias("doc"))


ODCS_SEVERITY = "CASE WHEN p_size % 3 = 0 THEN 'critical' ELSE 'error' END"


@query("odcs_rules", f"""
    SELECT CAST(p_partkey AS VARCHAR) AS contract, 'p_name' AS "column",
           CASE WHEN p_size > 25 THEN 'number' WHEN p_type = 'ECONOMY' THEN 'string'
                WHEN p_type = 'STANDARD' THEN 'datetime' ELSE 'any' END AS type,
           NOT (p_size > 25 OR p_size % 3 = 0) AS nullable, p_size = 1 OR p_size % 5 = 0 AS "unique",
           {ODCS_SEVERITY} AS severity FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'ignored', 'integer', true, true, 'error' FROM part""")
def odcs_rules(spark, sf_dir):
    objects = registry.odcs_objects(odcs_documents(spark, sf_dir), "doc", "id")
    return registry.odcs_columns(objects).select(
        "contract", "column", "type", "nullable", "unique", "severity")


@query("odcs_row_counts", """
    SELECT CAST(p_partkey AS VARCHAR) AS contract, 'parts' AS dataset_name, 'row_count' AS type,
           p_size + 1.0::DOUBLE AS minimum, CASE WHEN p_size > 25 THEN p_retailprice END AS maximum,
           'warning' AS severity, CASE WHEN p_size > 25 THEN p_brand ELSE 'crew' END AS owner FROM part""")
def odcs_row_counts(spark, sf_dir):
    objects = registry.odcs_objects(odcs_documents(spark, sf_dir), "doc", "id")
    counts = registry.odcs_row_counts(objects).drop("dataset_name")
    return counts.join(objects.select("contract", "dataset_name", "owner"), "contract").select(
        "contract", "dataset_name", "type", "minimum", "maximum", "severity", "owner")

"""Contracts as tables: inventory, audit, semantic diff and the ODCS adapter.

A registry holds many contracts in three tables (headers, column rules, dataset
rules), so lifecycle questions become joins and aggregates over all of them at once.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.functions.schemas import flat_schema
from tablepact.contract import SEVERITY_RANK, Contract, ContractError, read_payload

# Change classes with ranks, and the limits an audit checks.
CLASS_RANK = {
    "documentation_only": 10, "nonbreaking": 20, "potentially_breaking": 30, "breaking": 40,
}
MAX_HEADER_LENGTH = 512
MAX_REGEX_LENGTH = 512

# Physical type names (before any parenthesis) and their logical types.
PHYSICAL_TYPES = {
    "varchar": "string", "char": "string", "text": "string", "string": "string",
    "int": "integer", "integer": "integer", "long": "integer", "bigint": "integer",
    "smallint": "integer",
    "float": "number", "double": "number", "decimal": "number", "numeric": "number",
    "number": "number",
    "bool": "boolean", "boolean": "boolean",
    "date": "date", "timestamp": "datetime", "datetime": "datetime",
    "uuid": "uuid", "email": "email",
}

HEADER_SCHEMA = flat_schema(
    "contract string, version string, dataset_name string, contract_id string, description string, "
    "owner string, required_columns array<string>")
COLUMN_SCHEMA = flat_schema(
    "contract string, version string, column string, type string, nullable boolean, unique boolean, "
    "strict_type boolean, minimum double, maximum double, min_length bigint, max_length bigint, "
    "pattern string, allowed_values array<string>, maximum_age_hours double, severity string, "
    "description string, classification string")
RULE_SCHEMA = flat_schema(
    "contract string, version string, ordinal bigint, name string, type string, severity string, "
    "description string, columns array<string>, column string, minimum double, maximum double, "
    "max_ratio double, when_column string, when_equals string, then_column string, "
    "left_column string, right_expression string, tolerance double, reference_dataset string, "
    "reference_column string")


def registry_tables(spark: SparkSession, contracts: dict[str, Contract]) -> tuple[DataFrame, ...]:
    """(headers, column rules, dataset rules) of contracts by key; sized by the contracts."""
    headers, columns, rules = [], [], []

    def number(v):
        return None if v is None else float(v)

    for key, c in contracts.items():
        d, version = c.dataset, c.contract_version
        headers.append((key, version, d.name, d.contract_id, d.description, d.owner,
                        c.required_columns))
        for name, r in c.rules.items():
            allowed = None if r.allowed_values is None else [json.dumps(v) for v in r.allowed_values]
            columns.append((key, version, name, r.type, r.nullable, r.unique, r.strict_type,
                            number(r.minimum), number(r.maximum), r.min_length, r.max_length,
                            r.pattern, allowed, number(r.maximum_age_hours), r.severity,
                            r.description, r.classification))
        for i, r in enumerate(c.dataset_rules, 1):
            when = None if r.when_equals is None else json.dumps(r.when_equals)
            rules.append((key, version, i, r.name, r.type, r.severity, r.description, r.columns,
                          r.column, number(r.minimum), number(r.maximum), number(r.max_ratio),
                          r.when_column, when, r.then_column, r.left_column, r.right_expression,
                          number(r.tolerance), r.reference_dataset, r.reference_column))
    return (spark.createDataFrame(headers, HEADER_SCHEMA),
            spark.createDataFrame(columns, COLUMN_SCHEMA),
            spark.createDataFrame(rules, RULE_SCHEMA))


def contracts_of(headers: DataFrame, columns: DataFrame, rules: DataFrame) -> dict[str, Contract]:
    """Contracts read back from registry tables already narrowed to those wanted."""
    def settings(row, *left_out):
        return {k: v for k, v in row.asDict().items() if v is not None and k not in left_out}

    made: dict[str, dict] = {
        r["contract"]: {"contract_version": r["version"], "rules": {}, "dataset_rules": [], "dataset": {
            "name": r["dataset_name"], **settings(r, "contract", "version", "dataset_name")}}
        for r in headers.collect()
    }
    for r in columns.where(F.col("contract").isin(*made)).collect():
        rule = settings(r, "contract", "version", "column")
        if "allowed_values" in rule:
            rule["allowed_values"] = [json.loads(v) for v in rule["allowed_values"]]
        made[r["contract"]]["rules"][r["column"]] = rule
    for r in rules.where(F.col("contract").isin(*made)).orderBy("contract", "ordinal").collect():
        rule = settings(r, "contract", "version", "ordinal")
        if "when_equals" in rule:
            rule["when_equals"] = json.loads(rule["when_equals"])
        made[r["contract"]]["dataset_rules"].append(rule)
    return {key: Contract.from_dict(payload) for key, payload in made.items()}


def contract_fingerprint(contract: Contract) -> str:
    """SHA-256 of the contract's settings, whatever their order in the file."""
    return hashlib.sha256(json.dumps(asdict(contract), sort_keys=True).encode()).hexdigest()


def effective_rule_name() -> Column:
    """A rule's name, or its number among all rules of the contract."""
    return F.coalesce("name", F.concat(F.lit("dataset_rule_"), F.col("ordinal").cast("string")))


def _active_checks() -> list[tuple[str, Column]]:
    return [
        ("nullable", ~F.col("nullable")), ("type", F.col("type") != "any"),
        ("unique", F.col("unique")),
        *[(c, F.col(c).isNotNull()) for c in
          ("minimum", "maximum", "min_length", "max_length", "pattern", "allowed_values",
           "maximum_age_hours")],
    ]


def rule_inventory(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """(contract, version, rule_id): every check a contract switches on."""
    marks = [F.when(active, F.lit(check)) for check, active in _active_checks()]
    per_column = columns.select(
        "contract", "version", "column", F.explode(F.array_compact(F.array(*marks))).alias("check")
    ).select("contract", "version",
             F.concat(F.lit("column."), "check", F.lit(":"), "column").alias("rule_id"))
    per_dataset = rules.select(
        "contract", "version",
        F.concat(F.lit("dataset."), "type", F.lit(":"), effective_rule_name()).alias("rule_id"))
    return per_column.unionByName(per_dataset)


def duplicate_rule_names(rules: DataFrame) -> DataFrame:
    return rules.withColumn("rule_name", effective_rule_name()) \
        .groupBy("contract", "version", "rule_name").agg(F.count(F.lit(1)).alias("uses")) \
        .where(F.col("uses") > 1)


def audit(headers: DataFrame, columns: DataFrame, rules: DataFrame) -> DataFrame:
    """(contract, version, level, issue, subject): everything a reviewer should look at."""
    def issues(df, subject, *tests):
        marks = [F.when(F.coalesce(hit, F.lit(False)), F.struct(
            F.lit(level).alias("level"), F.lit(issue).alias("issue"))) for level, issue, hit in tests]
        return df.select("contract", "version", subject.alias("subject"),
                         F.explode(F.array_compact(F.array(*marks))).alias("i")) \
            .select("contract", "version", "i.level", "i.issue", "subject")

    def blank(c):
        return F.coalesce(F.col(c), F.lit("")) == ""

    per_header = issues(
        headers, F.col("dataset_name"),
        ("warning", "owner is not declared", blank("owner")),
        ("warning", "contract_id is not declared", blank("contract_id")),
        ("warning", "description is not declared", blank("description")),
        ("warning", "no required columns", F.coalesce(F.size("required_columns"), F.lit(0)) <= 0))
    per_column = issues(
        columns, F.col("column"),
        ("error", "column name too long", F.length("column") > MAX_HEADER_LENGTH),
        ("error", "pattern too long", F.length("pattern") > MAX_REGEX_LENGTH),
        ("error", "minimum above maximum", F.col("minimum") > F.col("maximum")),
        ("error", "min_length above max_length", F.col("min_length") > F.col("max_length")),
        ("error", "maximum_age_hours not positive", F.col("maximum_age_hours") <= 0),
        ("error", "unknown severity", ~F.col("severity").isin(*SEVERITY_RANK)))
    kind = F.col("type")
    per_rule = issues(
        rules, effective_rule_name(),
        ("error", "row_count without bounds",
         (kind == "row_count") & F.col("minimum").isNull() & F.col("maximum").isNull()),
        ("error", "unique_combination without columns",
         (kind == "unique_combination") & (F.coalesce(F.size("columns"), F.lit(0)) <= 0)),
        ("error", "null_ratio without column or max_ratio",
         (kind == "null_ratio") & (blank("column") | F.col("max_ratio").isNull())),
        ("error", "conditional_not_null without its columns",
         (kind == "conditional_not_null") & (blank("when_column") | F.col("then_column").isNull())),
        ("error", "aggregate_reconciliation without its sides",
         (kind == "aggregate_reconciliation") & (blank("left_column") | blank("right_expression"))),
        ("error", "reference_exists without its target",
         (kind == "reference_exists")
         & (blank("column") | blank("reference_dataset") | blank("reference_column"))),
        ("error", "max_ratio outside 0..1", ~F.col("max_ratio").between(0, 1)),
        ("error", "tolerance is negative", F.col("tolerance") < 0),
        ("error", "reference path is absolute",
         F.col("reference_dataset").rlike(r"^(/|\\|[A-Za-z]:|[a-z0-9]+://)")))
    twice = duplicate_rule_names(rules).select(
        "contract", "version", F.lit("error").alias("level"),
        F.lit("duplicate dataset rule name").alias("issue"), F.col("rule_name").alias("subject"))
    return per_header.unionByName(per_column).unionByName(per_rule).unionByName(twice)


def audit_verdict(issues: DataFrame, headers: DataFrame) -> DataFrame:
    """Per contract: number of errors and warnings, passed without errors."""
    counted = issues.groupBy("contract", "version").agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"))
    return headers.select("contract", "version").join(counted, ["contract", "version"], "left").select(
        "contract", "version", F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


# --- semantic diff ---------------------------------------------------------------

def _change(when: Column, path: Column, classification, before: Column, after: Column) -> Column:
    cls = F.lit(classification) if isinstance(classification, str) else classification
    return F.when(when, F.struct(
        path.alias("path"), cls.alias("classification"),
        before.cast("string").alias("before"), after.cast("string").alias("after")))


def _exploded(df: DataFrame, changes: list[Column]) -> DataFrame:
    return df.select("contract", F.explode(F.array_compact(F.array(*changes))).alias("c")) \
        .select("contract", "c.*")


def _sides(older: DataFrame, newer: DataFrame, keys: list[str], kept: list[str], how: str) -> DataFrame:
    o = older.select(*keys, F.struct(*kept).alias("o"))
    n = newer.select(*keys, F.struct(*kept).alias("n"))
    return o.join(n, keys, how)


def _differs(name: str) -> Column:
    return ~F.col(f"o.{name}").eqNullSafe(F.col(f"n.{name}"))


def _bound(name: str, tighter: Column) -> Column:
    """Breaking where the new bound exists and is new or tighter."""
    o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
    breaking = n.isNotNull() & (o.isNull() | tighter)
    path = F.concat(F.lit("rules."), "column", F.lit(f".{name}"))
    return _change(_differs(name), path, F.when(breaking, "breaking").otherwise("nonbreaking"), o, n)


def _flag(name: str, tight: bool) -> Column:
    """A switch: turning it to its strict position breaks consumers, back does not."""
    path = F.concat(F.lit("rules."), "column", F.lit(f".{name}"))
    cls = F.when(F.col(f"n.{name}") == tight, "breaking").otherwise("nonbreaking")
    return _change(_differs(name), path, cls, F.col(f"o.{name}"), F.col(f"n.{name}"))


def diff_headers(older: DataFrame, newer: DataFrame) -> DataFrame:
    kept = ["dataset_name", "contract_id", "description", "owner", "required_columns"]
    both = _sides(older, newer, ["contract"], kept, "inner")
    fields = {
        "dataset_name": ("dataset.name", "breaking"),
        "contract_id": ("dataset.contract_id", "potentially_breaking"),
        "description": ("dataset.description", "documentation_only"),
        "owner": ("dataset.owner", "documentation_only"),
    }
    metadata = [_change(_differs(f), F.lit(path), cls, F.col(f"o.{f}"), F.col(f"n.{f}")) for f, (path, cls) in fields.items()]

    def required(frm, to, cls, before, after):
        gone = F.array_except(F.coalesce(F.col(f"{frm}.required_columns"), F.array().cast("array<string>")),
                              F.coalesce(F.col(f"{to}.required_columns"), F.array().cast("array<string>")))
        return F.transform(gone, lambda c: F.struct(
            F.concat(F.lit("dataset.required_columns."), c).alias("path"), F.lit(cls).alias("classification"),
            F.lit(before).alias("before"), F.lit(after).alias("after")))

    # one explode: the joined headers are read once
    changes = F.concat(F.array_compact(F.array(*metadata)), required("n", "o", "breaking", "false", "true"),
                       required("o", "n", "nonbreaking", "true", "false"))
    return both.select("contract", F.explode(changes).alias("c")).select("contract", "c.*")


def diff_columns(older: DataFrame, newer: DataFrame) -> DataFrame:
    kept = [c for c in COLUMN_SCHEMA.names if c not in ("contract", "version", "column")]
    both = _sides(older, newer, ["contract", "column"], kept, "full_outer")
    o, n = F.col("o"), F.col("n")
    path = F.concat(F.lit("rules."), "column")
    whole = [
        # a column with a rule is always required, so a new rule can reject old data
        _change(o.isNull(), path, "breaking", F.lit(None), F.to_json(n)),
        _change(n.isNull(), path, "nonbreaking", F.to_json(o), F.lit(None))]
    ov, nv = F.array_distinct("o.allowed_values"), F.array_distinct("n.allowed_values")
    added = F.size(F.array_except(nv, ov)) > 0
    dropped = F.size(F.array_except(ov, nv)) > 0
    changed = F.when(ov.isNull() & nv.isNull(), False).when(ov.isNull() | nv.isNull(), True) \
        .otherwise(added | dropped)
    allowed = (
        F.when(ov.isNull(), "breaking").when(nv.isNull(), "nonbreaking")
        .when(dropped & ~added, "breaking").otherwise("potentially_breaking"))
    settings = [
        _change(_differs("type"), F.concat(path, F.lit(".type")), "breaking",
                F.col("o.type"), F.col("n.type")),
        _flag("nullable", False),
        _flag("unique", True),
        _bound("minimum", F.col("n.minimum") > F.col("o.minimum")),
        _bound("maximum", F.col("n.maximum") < F.col("o.maximum")),
        _change(changed, F.concat(path, F.lit(".allowed_values")), allowed,
                F.to_json("o.allowed_values"), F.to_json("n.allowed_values")),
        _bound("maximum_age_hours", F.col("n.maximum_age_hours") < F.col("o.maximum_age_hours")),
        _change(_differs("description"), F.concat(path, F.lit(".description")),
                "documentation_only", F.col("o.description"), F.col("n.description")),
    ]
    kept_rule = o.isNotNull() & n.isNotNull()
    return _exploded(both, [*whole, *(F.when(kept_rule, change) for change in settings)])


def diff_dataset_rules(older: DataFrame, newer: DataFrame) -> DataFrame:
    kept = [c for c in RULE_SCHEMA.names if c not in ("contract", "version", "ordinal")]

    def keyed(df):
        unnamed = F.concat(F.lit("unnamed:"), F.col("ordinal").cast("string"), F.lit(":"), "type")
        return df.withColumn("rule_name", F.coalesce("name", unnamed))

    both = _sides(keyed(older), keyed(newer), ["contract", "rule_name"], kept, "full_outer")
    before, after = F.to_json("o"), F.to_json("n")
    path = F.concat(F.lit("dataset_rules."), "rule_name")
    o, n = F.col("o"), F.col("n")
    return _exploded(both, [
        _change(o.isNull(), path, "potentially_breaking", before, after),
        _change(n.isNull(), path, "nonbreaking", before, after),
        _change(o.isNotNull() & n.isNotNull() & ~before.eqNullSafe(after), path,
                "potentially_breaking", before, after)])


def diff_contracts(older: tuple[DataFrame, ...], newer: tuple[DataFrame, ...]) -> DataFrame:
    """(contract, path, classification, before, after) for every contract in both registries."""
    return diff_headers(older[0], newer[0]) \
        .unionByName(diff_columns(older[1], newer[1])) \
        .unionByName(diff_dataset_rules(older[2], newer[2]))


def class_rank(classification: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in CLASS_RANK.items() for x in pair])
    return ranks[classification]


def diff_summary(changes: DataFrame, contracts: DataFrame, *more: DataFrame) -> DataFrame:
    """Per contract: the heaviest class of its changes, or 'none'.

    Contracts are those of the given headers; give both registries' for a row per contract of either.
    """
    for headers in more:
        contracts = contracts.select("contract").union(headers.select("contract"))
    heaviest = F.max_by("classification", class_rank(F.col("classification")))
    counted = changes.groupBy("contract").agg(
        heaviest.alias("classification"), F.count(F.lit(1)).alias("change_count"))
    return contracts.select("contract").distinct().join(counted, "contract", "left").select(
        "contract", F.coalesce("classification", F.lit("none")).alias("classification"),
        F.coalesce("change_count", F.lit(0)).alias("change_count"))


# --- ODCS documents --------------------------------------------------------------

_QUALITY = (
    "array<struct<metric: string, mustBe: double, mustBeGreaterThan: double, "
    "mustBeGreaterOrEqualTo: double, mustBeLessThan: double, mustBeLessOrEqualTo: double, "
    "severity: string, description: string>>")
ODCS_DDL = (
    "apiVersion string, kind string, version string, dataProduct string, "
    "team struct<name: string, members: array<struct<username: string, role: string>>>, "
    "schema array<struct<name: string, physicalName: string, businessName: string, "
    f"description: string, quality: {_QUALITY}, "
    "properties: array<struct<name: string, physicalName: string, logicalType: string, "
    "physicalType: string, required: boolean, unique: boolean, primaryKey: boolean, "
    f"description: string, classification: string, quality: {_QUALITY}>>>>")


def logical_type(declared: Column) -> Column:
    """Logical type of a declared type name; parameters such as (10,2) are ignored."""
    names = F.create_map(*[F.lit(x) for pair in PHYSICAL_TYPES.items() for x in pair])
    base = F.regexp_extract(F.trim(F.lower(declared)), r"^([a-z]+)(\(.*)?$", 1)
    return F.coalesce(F.try_element_at(names, base), F.lit("any"))


def _first_text(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def odcs_objects(documents: DataFrame, text: str, key: str, object_name: str | None = None) -> DataFrame:
    """One row per ODCS JSON document: its key, chosen schema object and owner."""
    doc = documents.select(F.col(key).alias("contract"), F.from_json(text, ODCS_DDL).alias("d"))
    if object_name is None:
        chosen = F.get("d.schema", F.lit(0))
    else:
        chosen = F.get(F.filter("d.schema", lambda s: (s["name"] == object_name)
                                | (s["physicalName"] == object_name)
                                | (s["businessName"] == object_name)), F.lit(0))
    owners = F.filter("d.team.members", lambda m: F.lower(m["role"]) == "owner")
    return doc.withColumn("obj", chosen).where(F.col("obj").isNotNull()).select(
        "contract", "obj", F.coalesce("d.apiVersion", F.lit("unknown")).alias("standard_version"),
        _first_text(F.get(owners, F.lit(0))["username"], F.col("d.team.name")).alias("owner"),
        _first_text(F.col("obj.physicalName"), F.col("obj.name"), F.col("d.dataProduct"),
                    F.lit("dataset")).alias("dataset_name"))


def odcs_columns(objects: DataFrame) -> DataFrame:
    """Column rules of the chosen objects: nested properties and quality become flat rows."""
    props = objects.select("contract", "dataset_name", F.explode("obj.properties").alias("p")) \
        .withColumn("column", F.trim(_first_text(F.col("p.physicalName"), F.col("p.name")))) \
        .where(F.coalesce(F.col("column"), F.lit("")) != "")
    quality = F.coalesce(F.col("p.quality"), F.array().cast(_QUALITY))

    def demands(q, *metrics):
        return q["metric"].isin(*metrics) & (q["mustBe"] == 0)

    no_nulls = F.exists(quality, lambda q: F.coalesce(demands(q, "nullValues"), F.lit(False)))
    no_twins = F.exists(quality, lambda q: F.coalesce(
        demands(q, "duplicateValues", "duplicates"), F.lit(False)))
    stated = F.filter(quality, lambda q: demands(q, "nullValues", "duplicateValues", "duplicates")
                      & F.lower(q["severity"]).isin(*SEVERITY_RANK))
    severity = F.coalesce(F.lower(F.try_element_at(stated, F.lit(-1))["severity"]), F.lit("error"))
    off = F.lit(False)
    return props.select(
        "contract", "dataset_name", "column",
        logical_type(_first_text(F.col("p.logicalType"), F.col("p.physicalType"))).alias("type"),
        (~(F.coalesce("p.required", off) | no_nulls)).alias("nullable"),
        (F.coalesce("p.unique", off) | F.coalesce("p.primaryKey", off) | no_twins).alias("unique"),
        severity.alias("severity"), F.col("p.description").alias("description"),
        F.col("p.classification").alias("classification"))


def odcs_row_counts(objects: DataFrame) -> DataFrame:
    """row_count rules of the chosen objects; exclusive bounds become inclusive ones."""
    q = objects.select("contract", "dataset_name", F.explode("obj.quality").alias("q")) \
        .where(F.col("q.metric") == "rowCount")
    low = F.coalesce("q.mustBeGreaterOrEqualTo", F.col("q.mustBeGreaterThan") + 1, "q.mustBe")
    high = F.coalesce("q.mustBeLessOrEqualTo", F.col("q.mustBeLessThan") - 1, "q.mustBe")
    sev = F.lower("q.severity")
    return q.select(
        "contract", "dataset_name", F.lit("odcs_row_count").alias("name"),
        F.lit("row_count").alias("type"), low.alias("minimum"), high.alias("maximum"),
        F.when(sev.isin(*SEVERITY_RANK), sev).otherwise("error").alias("severity"),
        F.col("q.description").alias("description"),
    ).where(F.col("minimum").isNotNull() | F.col("maximum").isNotNull())


def contract_from_odcs(spark: SparkSession, payload: dict, object_name: str | None = None) -> Contract:
    """One ODCS document as a contract (one document, so the result is contract-sized)."""
    one = spark.createDataFrame([("c", json.dumps(payload))], "id string, doc string")
    objects = odcs_objects(one, "doc", "id", object_name)
    head = objects.select("dataset_name", "owner", "standard_version", "obj.description").first()
    if head is None:
        raise ContractError(f"ODCS document has no schema object {object_name or ''}".rstrip())
    columns = {
        r["column"]: {k: r[k] for k in ("type", "nullable", "unique", "severity", "description",
                                        "classification")}
        for r in odcs_columns(objects).collect()
    }
    rules = [{k: r[k] for k in ("name", "type", "minimum", "maximum", "severity", "description")}
             for r in odcs_row_counts(objects).collect()]
    return Contract.from_dict({
        "dataset": {"name": head["dataset_name"], "owner": head["owner"],
                    "description": head["description"], "required_columns": list(columns)},
        "rules": columns, "dataset_rules": rules, "source_format": "odcs",
        "source_standard_version": head["standard_version"],
        "adapter_notes": ["One schema object per contract; unmapped metadata is not enforced."],
    })


def load_any_contract(spark: SparkSession, path: str, object_name: str | None = None) -> Contract:
    """A contract file in the native or the ODCS form, told apart by its header."""
    payload = read_payload(path)
    if payload.get("kind") == "DataContract" or str(payload.get("apiVersion", "")).startswith("v3"):
        return contract_from_odcs(spark, payload, object_name)
    return Contract.from_dict(payload)

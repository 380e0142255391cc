"""Personal-data signals, the policy on them, and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from tablepact import Contract
from tablepact.operators import pii
from tablepact.operators.redact import redact_json, redact_text
from tablepact.operators.schema_checks import observed_columns

V4 = r"((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SPACES = r" ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) "
DIGITS = r"regexp_replace({v}, '\D', '', 'g')"
# doubled digits from the right, nine taken off above nine
LUHN = """(length({d}) BETWEEN 13 AND 19 AND
  list_sum(list_transform(range(1, length({d}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST({d}[-i] AS INT)
         WHEN CAST({d}[-i] AS INT) > 4 THEN 2 * CAST({d}[-i] AS INT) - 9
         ELSE 2 * CAST({d}[-i] AS INT) END)) % 10 = 0)"""
TESTS = {
    "email": r"regexp_full_match({v}, '[^\s@]+@[^\s@]+\.[^\s@]+')",
    "government_id": r"regexp_full_match({v}, '\d{{3}}-?\d{{2}}-?\d{{4}}')",
    "phone": r"(regexp_full_match({v}, '\+?[\d\s().-]{{10,20}}') AND length(" + DIGITS + ") >= 10)",
    "payment_card": LUHN.replace("{d}", "(" + DIGITS + ")"),
    "ip_address": "regexp_full_match({v}, '" + V4.replace("{", "{{").replace("}", "}}") + "')",
}


def test_sql(category, value):
    return TESTS[category].format(v=f"trim({value}, {SPACES})")


WORDS = r"(SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS word FROM documents)"


def words(spark, sf_dir):
    """Every blank-separated word of every document as a cell of its own."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", r"[ \t\n\r]+")).alias("word"))


def _detector(name, category):
    @query(name, f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS "values" FROM {WORDS}
                     WHERE {test_sql(category, 'word')} GROUP BY doc_id""")
    def run(spark, sf_dir):
        hit = pii.value_detectors(F.col("word"))[category]
        return words(spark, sf_dir).where(hit).groupBy("doc_id").agg(F.count(F.lit(1)).alias("values"))


_detector("pii_email", "email")
_detector("pii_ip", "ip_address")

CONTACT_COLUMNS = ("customer_id", "email_address", "mobile", "tax_id", "card_number", "note")


def contacts(spark, sf_dir):
    """Customers with contact columns derived from their key and balance."""
    k = F.col("c_custkey")
    pad = F.lpad(k.cast("string"), 4, "0")
    return table(spark, sf_dir, "customer").select(
        k.alias("customer_id"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email_address"),
        F.concat(F.lit("+1 (555) 010-"), pad).alias("mobile"),
        F.concat(F.lit("123-45-"), pad).alias("tax_id"),
        F.concat(F.lit("4111-1111-1111-"), pad).alias("card_number"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("10.0."), (k % 300).cast("string"), F.lit(".1")))
        .otherwise(F.col("c_mktsegment")).alias("note"))


CONTACTS = """(SELECT c_custkey AS customer_id,
    lower(replace(c_name, '#', '.')) || '@example.com' AS email_address,
    '+1 (555) 010-' || p AS mobile, '123-45-' || p AS tax_id, '4111-1111-1111-' || p AS card_number,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '10.0.' || (c_custkey % 300) || '.1' ELSE c_mktsegment END AS note
    FROM (SELECT *, substr(lpad(CAST(c_custkey AS VARCHAR), 4, '0'), 1, 4) AS p FROM customer))"""


def _cells(name, category, column):
    @query(name, f"""SELECT customer_id, {test_sql(category, column)} AS hit FROM {CONTACTS}""")
    def run(spark, sf_dir):
        hit = pii.value_detectors(F.col(column))[category]
        return contacts(spark, sf_dir).select("customer_id", hit.alias("hit"))


_cells("pii_government_id", "government_id", "tax_id")
_cells("pii_phone", "phone", "mobile")
_cells("pii_payment_card", "payment_card", "card_number")

NAMED = {"customer_id": ["account_identifier"], "email_address": ["email", "address"], "mobile": ["phone"],
         "tax_id": ["government_id"], "card_number": ["payment_card"], "note": []}


def _signals_sql(source, sampled="false"):
    parts = []
    for column in CONTACT_COLUMNS:
        for category in (*TESTS, "account_identifier", "address"):
            name_signal = str(category in NAMED[column]).lower()
            matches = "0"
            if category in TESTS:
                matches = f"count(*) FILTER ({test_sql(category, f'CAST({column} AS VARCHAR)')})"
            parts.append(f"""SELECT '{column}' AS "column", '{category}' AS category, {name_signal} AS name_signal,
                CAST(count({column}) AS BIGINT) AS sampled_values, CAST({matches} AS BIGINT) AS matching_values
                FROM {source}""")
    union = " UNION ALL ".join(parts)
    return f"""SELECT "column", category, name_signal, {sampled} AS sampled, sampled_values, matching_values,
        round(matching_values / sampled_values, 4) AS match_ratio,
        CASE WHEN name_signal AND matching_values >= 0.5 * sampled_values THEN 'high'
             WHEN name_signal OR matching_values >= 0.5 * sampled_values THEN 'medium' ELSE 'low' END AS confidence
        FROM ({union}) WHERE name_signal OR matching_values > 0"""


@query("pii_signals", _signals_sql(CONTACTS))
def pii_signals(spark, sf_dir):
    return pii.pii_signals(contacts(spark, sf_dir))


@query("pii_signals_sampled", _signals_sql(f"(SELECT * FROM {CONTACTS} ORDER BY customer_id LIMIT 200)", "true"))
def pii_signals_sampled(spark, sf_dir):
    """Only the first 200 filled values of each column, in key order."""
    return pii.pii_signals(contacts(spark, sf_dir), row_key="customer_id", sample_limit=200)


LATE = "(SELECT c_custkey, CASE WHEN c_custkey > 100 THEN 'u' || c_custkey || '@x.org' END AS contact FROM customer)"


@query("pii_sampled_sparse", f"""
    SELECT 'contact' AS "column", 'email' AS category, CAST(least(20, count(contact)) AS BIGINT) AS sampled_values,
           CAST(least(20, count(contact)) AS BIGINT) AS matching_values, true AS sampled FROM {LATE} HAVING count(contact) > 0""")
def pii_sampled_sparse(spark, sf_dir):
    """A column that is filled late is sampled where it is filled, with and without a row key."""
    late = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") > 100, F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).alias("contact"))
    return pii.pii_signals(late, sample_limit=20).select("column", "category", "sampled_values", "matching_values", "sampled")


PRIVACY = {"allowed_categories": ["email", "account_identifier"], "fail_on_unapproved": True}


@query("pii_policy_findings", f"""
    SELECT 'privacy.unapproved_pii_signal' AS rule_id, 'error' AS severity, "column",
           confidence || '-confidence ' || category || ' signal' AS observed
    FROM ({_signals_sql(CONTACTS)}) WHERE category NOT IN ('email', 'account_identifier')""")
def pii_policy_findings(spark, sf_dir):
    contract = Contract.from_dict({"dataset": {"name": "contacts"}, "privacy": PRIVACY})
    found = pii.privacy_findings(pii.pii_signals(contacts(spark, sf_dir)), contract)
    return found.select("rule_id", "severity", "column", "observed")


@query("pii_name_signals", f"""
    SELECT 'contacts' AS dataset, "column", category, filled FROM (
      SELECT unnest(['customer_id', 'email_address', 'email_address', 'mobile', 'tax_id', 'card_number']) AS "column",
             unnest(['account_identifier', 'email', 'address', 'phone', 'government_id', 'payment_card']) AS category,
             CAST(count(*) AS BIGINT) AS filled FROM {CONTACTS})""")
def pii_name_signals(spark, sf_dir):
    """Catalogue columns whose names point to personal data, with how much they hold."""
    tables = {"contacts": contacts(spark, sf_dir), "orders": table(spark, sf_dir, "orders")}
    return pii.name_signals(observed_columns(tables)).select("dataset", "column", "category", "filled")


SECRET = r"(api[_-]?key|token|password|secret|authorization)\s*[:=]\s*[^\s,;]+"
REDACTED = (r"regexp_replace(regexp_replace({v}, '" + SECRET + r"', '\1=[REDACTED]', 'gi'), "
            r"'\b(\d{{1,3}}\.){{3}}\d{{1,3}}\b', '[IP_REDACTED]', 'g')")


@query("redact_text", f"""
    SELECT doc_id, sha256({REDACTED.format(v='text')}) AS digest, {REDACTED.format(v='text')} <> text AS changed
    FROM documents""")
def redact_documents(spark, sf_dir):
    masked = redact_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(masked, 256).alias("digest"), (masked != F.col("text")).alias("changed"))


@query("redact_json", """
    SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","token":"[REDACTED]","host":"[IP_REDACTED]"}'
           AS props FROM events""")
def redact_events(spark, sf_dir):
    """Event properties with a secret-named entry and an address added, then redacted."""
    parsed = F.from_json("props", "map<string,string>")
    more = F.map_concat(parsed, F.create_map(
        F.lit("token"), F.col("event_type"), F.lit("host"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))))
    return table(spark, sf_dir, "events").select(
        "event_id", redact_json(F.to_json(more)).alias("props"))


@query("redact_json_nested", """
    SELECT event_id, CASE event_id % 4
        WHEN 0 THEN '{"user":{"password":"[REDACTED]","n":' || user_id || '},"ok":true}'
        WHEN 1 THEN '[{"token":"[REDACTED]"},"at [IP_REDACTED]",' || user_id || ',null]'
        WHEN 2 THEN 'password=[REDACTED]' ELSE CAST(user_id AS VARCHAR) END AS props FROM events""")
def redact_nested(spark, sf_dir):
    """Secrets inside objects and arrays, texts that are no JSON, and bare numbers."""
    n = F.col("user_id").cast("string")
    made = F.when(F.col("event_id") % 4 == 0, F.concat(
        F.lit('{"user": {"password": {"old": "a", "new": ["b"]}, "n": '), n, F.lit('}, "ok": true}'))) \
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('[{"token": 5}, "at 10.0.0.7", '), n, F.lit(", null]"))) \
        .when(F.col("event_id") % 4 == 2, F.lit("password: hunter2")).otherwise(n)
    return table(spark, sf_dir, "events").select("event_id", redact_json(made).alias("props"))


@query("redact_json_cut", """
    SELECT event_id, CASE event_id % 5
        WHEN 0 THEN '{"n":' || user_id || ',"password":"[REDACTED]"'
        WHEN 1 THEN '[{"Token":"[REDACTED]", "host":"[IP_REDACTED]", "n": ' || user_id
        WHEN 2 THEN '{"n":' || user_id || ',"secret":"[REDACTED]"'
        WHEN 3 THEN '{"api_key":"[REDACTED]"' ELSE '{"n":' || user_id || ',"passwords":"kept"' END AS props FROM events""")
def redact_cut(spark, sf_dir):
    """Objects and arrays that were cut off: what their secret-named entries hold is masked all the same."""
    n, kind = F.col("user_id").cast("string"), F.col("event_id") % 5
    made = F.when(kind == 0, F.concat(F.lit('{"n":'), n, F.lit(',"password": "p-\\"'), n)) \
        .when(kind == 1, F.concat(F.lit('[{"Token" : 12.5e, "host":"10.0.0.7", "n": '), n)) \
        .when(kind == 2, F.concat(F.lit('{"n":'), n, F.lit(',"secret":{"a":["x", "'), n)) \
        .when(kind == 3, F.concat(F.lit('{"api_key":"k'), n, F.lit("\\"))) \
        .otherwise(F.concat(F.lit('{"n":'), n, F.lit(',"passwords":"kept"')))
    return table(spark, sf_dir, "events").select("event_id", redact_json(made).alias("props"))

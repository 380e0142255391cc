"""The operators as registered queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablepact.llm import (byte_bpe, merkle, near_dedup, packing, quality, secrets, sharding, suffix_dedup, token_counts, tool_calls, variants,
                           wavelet, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_wavelet_matrix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

_EIGHT = " || chr(32) || ".join(["w", *(f"lead(w, {k}) OVER ahead" for k in range(1, 8))])

OP4_SQL = rf"""
    WITH split AS (
        SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    tokens AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
    windows AS (
        SELECT rid, i, {_EIGHT} AS w FROM tokens
        WINDOW ahead AS (PARTITION BY rid ORDER BY i) QUALIFY lead(w, 7) OVER ahead IS NOT NULL),
    repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
    covered AS (
        SELECT rid, sum(least(8, coalesce(following - i, 8))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM repeated) GROUP BY rid),
    counted AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
               CAST(len(lines) AS BIGINT) AS n_lines,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS BIGINT) AS n_ellipsis_lines,
               CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS BIGINT) AS n_bullet_lines,
               CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
        FROM split LEFT JOIN covered USING (rid)),
    failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
    SELECT *, NOT base_failed
              AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words
              AND 100 * n_symbols <= 10 * n_words AND 100 * n_stop_words >= 2 * n_words
              AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_ellipsis_lines <= 30 * n_lines
              AND 100 * n_bullet_lines <= 90 * n_lines AS kept
    FROM failed"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                  with_ids=False)


@query("op2_karmarkar_karp")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     with_ids=False)


@query("op8_suffix_array_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


@query("op6_order_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def _print_sql(tree: str) -> str:
    node, shown = "sha256({})".format, "substr({}, 1, 12)".format
    joined = lambda x: f"array_to_string({x}, '')"
    section = node(joined(f"list_transform(s, lambda q: {node(joined('q'))})"))
    section_2 = section.replace("(s,", "(z,").replace("lambda q", "lambda y").replace("'q'", "'y'").replace("(q,", "(y,")
    paragraph = f"{shown(node(joined('p')))} || '(' || array_to_string(list_transform(p, lambda l: {shown('l')}), '.') || ')'"
    return (f"sha256({joined(f'list_transform({tree}, lambda z: {section_2})')}) || '|' || array_to_string(list_transform({tree}, "
            f"lambda s: {shown(section)} || '[' || array_to_string(list_transform(s, lambda p: {paragraph}), ',') || ']'), '|')")


def _tree_sql(text: str) -> str:
    escaped = f"replace(replace({text}, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a')"
    marked = f"replace(replace(replace({escaped}, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1))"
    return (f"list_transform(string_split({marked}, chr(10) || chr(10)), lambda a: list_transform(string_split(a, chr(10)), "
            f"lambda b: list_transform(string_split(b, chr(1)), lambda c: sha256(c))))")


OP10_SQL = f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    pairs AS (
        SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM docs),
    edits AS (
        SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS e FROM pairs),
    trees AS (SELECT *, {_tree_sql('t')} AS own, {_tree_sql('e')} AS changed, flatten(flatten({_tree_sql('nt')})) AS nl FROM edits),
    flat AS (SELECT *, flatten(flatten(own)) AS ol, flatten(flatten(changed)) AS cl FROM trees)
    SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256,
           {_print_sql('own')} AS fingerprint, {_print_sql('changed')} AS edited_fingerprint,
           len(list_intersect(list_distinct(ol), list_distinct(cl))) / len(list_distinct(list_concat(ol, cl))) AS near_edited,
           len(list_intersect(list_distinct(ol), list_distinct(nl))) / len(list_distinct(list_concat(ol, nl))) AS near_next
    FROM flat"""


@query("op10_merkle_fingerprints", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(table(spark, sf_dir, "documents"))


OP7_SQL = """
    WITH turns AS (
        SELECT conv_id, turn, role, text,
               CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
               CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS asked
        FROM conversations),
    named AS (SELECT *, 'call-' || conv_id || '-' || asked AS call_id FROM turns),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, call_id, kind ORDER BY turn, text) AS nth FROM named),
    firsts AS (SELECT conv_id, call_id, kind, text FROM numbered WHERE nth = 1 AND kind <> 'message'),
    met AS (
        SELECT n.*, f.call_id IS NOT NULL AS met, f.text AS other
        FROM numbered n LEFT JOIN firsts f ON n.conv_id = f.conv_id AND n.call_id = f.call_id AND f.kind <> n.kind),
    judged AS (
        SELECT *, CASE WHEN kind = 'message' THEN 'message' WHEN nth > 1 THEN 'repeated' WHEN met THEN 'linked'
                       WHEN kind = 'call' THEN 'open' ELSE 'orphan' END AS status,
               CASE WHEN kind = 'call' THEN text IS NOT NULL AND length(text) BETWEEN 1 AND 1000 END AS valid
        FROM met)
    SELECT conv_id, turn, kind, call_id, CASE WHEN kind = 'call' THEN 'ask' END AS name, status, turn AS place, valid,
           CASE kind
             WHEN 'call' THEN
               '{"arguments":{"lang_hint":"' || CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'other' END
               || '","n_chars":' || length(text) || ',"prompt":' || to_json(text) || '},"content":null,"id":"' || call_id
               || '","name":"ask","result":' || CASE WHEN status = 'linked' THEN to_json(other) ELSE 'null' END
               || ',"status":"' || status || '","valid":' || valid || '}'
             WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || call_id || '","status":"' || status || '"}'
             ELSE '{"content":' || to_json(text) || ',"status":"message"}' END AS record
    FROM judged"""


@query("op7_tool_call_linking", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = tool_calls.messages_of_turns(table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(messages, {"ask": tool_calls.ASK}).drop("uses")


@query("op11_secret_scans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))

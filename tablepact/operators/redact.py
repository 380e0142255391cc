"""Masking of secrets and addresses in text and JSON columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a secret, the masks and the text limit. The lookahead that leads
# the first pattern only turns other text away sooner.
SECRET_TEXT = r"(?iU)(?=[apts])(api[_-]?key|token|password|secret|authorization)\s*[:=]\s*[^\s,;]+"
SECRET_NAME = r"(?i)^(api[_-]?key|token|password|secret|authorization)$"
CUT_ENTRY = r"(?isU)\"(api[_-]?key|token|password|secret|authorization)\"\s*:\s*(\"(?:[^\"\\]|\\.)*+(?:\"|\\?$)|[\[{].*$|[^\s,}\]]+)"
IPV4_TEXT = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
# the same two for Python: its classes are Unicode already
_SECRET, _IPV4 = re.compile(SECRET_TEXT.replace("(?iU)", "(?i)")), re.compile(IPV4_TEXT.replace("(?U)", ""))
SECRET_MASK = "[REDACTED]"
IP_MASK = "[IP_REDACTED]"
TEXT_LIMIT = 20_000  # what diagnostic exports keep of a text


def redact_text(text: Column, limit: int | None = None) -> Column:
    """Secrets after a key word and IPv4 addresses masked.

    Whole texts by default; pass ``TEXT_LIMIT`` to cut diagnostic output.
    """
    masked = F.regexp_replace(text, SECRET_TEXT, "$1=" + SECRET_MASK)
    masked = F.regexp_replace(masked, IPV4_TEXT, IP_MASK)
    return masked if limit is None else F.substring(masked, 1, limit)


def redact_map(values: Column, limit: int | None = None) -> Column:
    """A map whose secret-named entries are masked whole and all others as text."""
    return F.transform_values(
        values,
        lambda k, v: F.when(k.rlike(SECRET_NAME), F.lit(SECRET_MASK)).otherwise(redact_text(v, limit)))


def redact_json(json_text: Column, limit: int | None = None) -> Column:
    """JSON text with secret-named entries masked at any depth and all other strings redacted as text.

    Numbers, booleans and nulls keep their type. An object or array that does not parse (cut off, say) has its secret-named
    entries masked by their quoted names, a nested value to the end of the cell, and the rest redacted as text. JSON
    nests to any depth, which built-in expressions cannot follow, so cells that hold an object
    or array go through one vectorised function; other cells never leave the JVM.
    """
    nested = json_text.rlike(r"^\s*[\[{]")
    walked = F.when(nested, _walked(F.when(nested, json_text)))
    broken = F.when(nested, redact_text(F.regexp_replace(json_text, CUT_ENTRY, '"$1":"' + SECRET_MASK + '"')))
    text = F.coalesce(walked, broken, redact_text(json_text))
    return text if limit is None else F.substring(text, 1, limit)


def _masked(value: object) -> object:
    if isinstance(value, dict):
        return {k: SECRET_MASK if re.match(SECRET_NAME, k) else _masked(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_masked(v) for v in value]
    if isinstance(value, str):
        return re.sub(_IPV4, IP_MASK, re.sub(_SECRET, lambda m: f"{m[1]}={SECRET_MASK}", value))
    return value


@F.pandas_udf(T.StringType())
def _walked(cells: pd.Series) -> pd.Series:
    """Redacted JSON per cell; null where a cell is null or does not parse."""
    def walk(cell: str | None) -> str | None:
        if cell is None:
            return None
        try:
            return json.dumps(_masked(json.loads(cell)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None
    return cells.map(walk, na_action="ignore")

"""SQL text built from Python values."""

from __future__ import annotations


class Sql(str):
    """A SQL fragment where a plain string would be taken as text."""


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

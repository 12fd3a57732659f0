"""Scalar functions on raw tool output: JSON repair, hex bytes, p-code lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements that join the tool's concatenated arrays; the first two come before the outer brackets.
JOINED = [("[]\n", ","), ("}]\n[{", "}],\n[{")]
WRAPPED = [("}]\n,]", "}]\n]"), ("\n,,[{", "\n,[{"), ("\n,,[{", "\n,[{")]


def repaired_json(raw: Column) -> Column:
    """Concatenated JSON arrays as one array of arrays; nothing but empty ones gives `[]`."""
    for old, new in JOINED:
        raw = F.replace(raw, F.lit(old), F.lit(new))
    raw = F.concat(F.lit("["), raw, F.lit("]"))
    for old, new in WRAPPED:
        raw = F.replace(raw, F.lit(old), F.lit(new))
    return F.when(raw == "[,]", "[]").otherwise(raw)


def hex_bytes(text: Column) -> Column:
    """Bytes of a hex string; null where it isn't one."""
    return F.unhex(text)


def escaped_bytes(text: Column) -> Column:
    r"""Bytes of the `\xNN` escapes in a text; anything else is passed over."""
    return F.unhex(F.array_join(F.regexp_extract_all(text, F.lit(r"\\x([0-9a-fA-F]{2})"), F.lit(1)), ""))


def assembly_lines(lines: Column) -> Column:
    """Trimmed lines that start with an address."""
    return F.transform(F.filter(lines, lambda x: x.startswith("0x")), lambda x: F.trim(x))


def pcode_lines(lines: Column) -> Column:
    """Trimmed lines that don't."""
    return F.transform(F.filter(lines, lambda x: ~x.startswith("0x")), lambda x: F.trim(x))


def field(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)

"""Instruction normalisation as column expressions: JVM-side, in generated code.

Rewrites run in a fixed order, since later patterns see what earlier ones wrote. Java's
`.` stops at more line ends than the patterns mean, so they run with UNIX lines, and
white-space classes are Unicode's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gantry.functions.opcodes import FRAME_POINTERS, REGISTERS_32, REGISTERS_64, REGISTERS_RISCV

# Patterns of disassembly text and what they become, in order.
DISASM_PATTERNS = [
    (r"(0xffff[0-9a-fA-F]{1,})", "IMM"),
    (r"(0[xX][0-9a-fA-F]{1,3}])", "IMM]"),
    (r"(0[xX][0-9a-fA-F]{1,4})\(", "IMM("),
    (r"(case\.|0x|aav\.){0,1}0x[0-9a-fA-F]{3,}(.[0-9]){0,}", "MEM"),
    (r"(str\S*[^!\s][_|s]{0,1})", "STR"),
    (r"method.*[^!\s]\(*.*(\)|>*)", "FUNC"),
    (r"(fcn|sym).*[^!\s]", "FUNC"),
    (r"[-]{0,1}[\[]{0,1}obj\S*[\]]{0,1}", "DATA"),
    (r"\[reloc\S*\]", "FUNC"),
    (r"loc.[a-z]+.[a-z_]+", "FUNC"),
    (r"nop.*", "nop"),
]
# Patterns of ESIL text, in order; the last depends on the instruction's type.
ESIL_PATTERNS = [
    (r"(0xffff[0-9a-fA-F]{1,},)", "IMM,"),
    (r"(0[xX][0-9a-fA-F]{1,3},)", "IMM,"),
    (r"(0[xX][0-9a-fA-F]{4,},)", "MEM,"),
]
ESIL_NUMBER = r"([0-9]{4,}?,)"
# Of each disassembly pattern, the texts of which a match holds one.
DISASM_HOLDS = [("0xffff",), ("]",), ("(",), ("0x",), ("str",), ("method",), ("fcn", "sym"), ("obj",), ("[reloc",), ("loc",), ("nop",)]


def _rewrite(text: Column, patterns: list[tuple[str, str]], flags: str) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, F.lit(flags + p[0]), F.lit(p[1])), patterns, text)


def _rewrite_where(texts: Column, patterns: list[tuple[str, str]], holds: list[tuple[str, ...]], flags: str) -> Column:
    """As `_rewrite` on an array, but a pattern is only tried on texts that hold what its matches hold: a search costs a fraction of a match."""

    def rule(pattern: str, by: str, parts: tuple[str, ...]):
        may = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in parts])
        return lambda t: F.when(may(t), F.regexp_replace(t, F.lit(flags + pattern), F.lit(by))).otherwise(t)

    return reduce(F.transform, [rule(*p, parts) for p, parts in zip(patterns, holds, strict=True)], texts)


def _masked_disasm(token: Column) -> Column:
    """The class of a register token; others stay. The first rule that fits decides."""
    ends = token.endswith("]")
    inner = F.when(ends, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(F.substring(token, F.lit(2), F.length(token)))
    tail = F.when(ends, "]").otherwise("")
    parts = F.transform(F.split(token, r"\*"), lambda p: F.when(p.isin(REGISTERS_64), "reg64").otherwise(p))
    return (
        F.when(token.isin(FRAME_POINTERS), "fp")
        .when(token.isin(REGISTERS_32), "reg32")
        .when(token.isin(REGISTERS_64), "reg64")
        .when(token.startswith("[") & inner.isin(REGISTERS_32), F.concat(F.lit("[reg32"), tail))
        .when(token.startswith("[") & inner.isin(REGISTERS_64), F.concat(F.lit("[reg64"), tail))
        .when(token.startswith("["), token)
        .when(token.contains("*"), F.array_join(parts, "*"))
        .otherwise(token)
    )


def _spaced(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(","), F.lit(" ")), F.lit("  "), F.lit(" "))


def _masked(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda t: t != ""), _masked_disasm), " ")


def disasm(text: Column, registers: bool = False, unicode: bool = True) -> Column:
    """Normalised disassembly; `registers` masks register names. Null stays null.

    unicode: white-space classes as in Unicode; False for ASCII classes.
    """
    out = _rewrite(_spaced(text), DISASM_PATTERNS, "(?Ud)" if unicode else "(?d)")
    return _masked(out) if registers else out


def disasm_array(texts: Column, registers: bool = False) -> Column:
    """`disasm` of each text of an array: one pass over the array for each pattern."""
    out = _rewrite_where(F.transform(texts, _spaced), DISASM_PATTERNS, DISASM_HOLDS, "(?Ud)")
    return F.transform(out, _masked) if registers else out


def esil(text: Column, op_type: Column, registers: bool = False) -> Column:
    """Normalised ESIL. Masking joins the parts by spaces; without it the commas stay."""
    out = _rewrite(text, ESIL_PATTERNS, "")
    out = F.regexp_replace(out, F.lit(ESIL_NUMBER), F.when(op_type == "call", "FUNC,").otherwise("DATA,"))
    if not registers:
        return out

    def masked(t: Column) -> Column:
        return F.when(t.isin(REGISTERS_32 + REGISTERS_RISCV), "reg32").when(t.isin(REGISTERS_64), "reg64").otherwise(t)

    return F.array_join(F.transform(F.filter(F.split(out, ","), lambda t: t != ""), masked), " ")

"""Basic-block features: exclusive and overlapping opcode counts, offspring, architecture.

Two forms of each count. On nested functions (arrays of blocks and operations) counts
are higher-order expressions within a row: no explode and no shuffle. On flat tables
`class_counts` and `overlapping_counts` are one grouped sum of conditions, whose partial
sums are taken before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.functions.opcodes import ARCHITECTURES, CLASSES, GROUPS, OVERLAPPING

Rules = Sequence[tuple[str, Column]]

# Names of the features in each set, as written to node documents.
GEMINI = ("numCalls", "numTransfer", "numArith", "numIns", "numericConsts", "stringConsts", "numOffspring")
DISCOVRE = GEMINI[:6]
DGIS = ("numStackOps", "numArithOps", "numLogicOps", "numCmpOps", "numLibCalls", "numUnconJumps", "numConJumps", "numGenericIns")
TIKNIB = ("arithshift", "compare", "ctransfer", "ctransfercond", "dtransfer", "float", "total")
FEATURES = {"gemini": GEMINI, "discovre": DISCOVRE, "dgis": DGIS, "tiknib": TIKNIB}


def once(value: Column, body) -> Column:
    """`body` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def opcode(kind: Column, text: Column) -> Column:
    """Mnemonic: none for invalid instructions, `nop` for nops, else the text's first word."""
    word = F.nullif(F.regexp_extract(text, r"(\S+)", 1), F.lit(""))
    return F.when(kind == "invalid", F.lit(None)).when(kind == "nop", F.lit("nop")).otherwise(word)


def op_opcode(op: Column) -> Column:
    return once(F.regexp_extract(op["opcode"], r"(\S+)", 1), lambda word: F.when(op["type"] == "invalid", F.lit(None)).when(op["type"] == "nop", F.lit("nop")).when(word != "", word))


def first_class(rules: Rules, other: str | None = None) -> Column:
    """Name of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), name)
    return out.otherwise(other)


def in_class(code: Column, arch: Column, name: str) -> Column:
    """Whether an opcode is in a class of the architecture that the row names."""
    out = F.lit(False)
    for a in ARCHITECTURES:
        if CLASSES[a][name]:
            out = F.when(arch == a, code.isin(CLASSES[a][name])).otherwise(out)
    return out


def in_group(code: Column, arch: Column, names: Sequence[str]) -> Column:
    out = F.lit(False)
    for a in ARCHITECTURES:
        out = F.when(arch == a, code.isin([w for n in names for w in GROUPS[a][n]])).otherwise(out)
    return out


def _ops(block: Column) -> Column:
    """Operations that have an opcode, with it and whether their text names a library call, number or string."""
    text = lambda o: F.coalesce(o["disasm"], F.lit(""))
    return F.filter(
        F.transform(block["ops"], lambda o: F.struct(op_opcode(o).alias("code"), text(o).contains("imp").alias("lib"), text(o).contains(", 0x").alias("number"), text(o).contains(" str.").alias("string"))),
        lambda o: o["code"].isNotNull(),
    )


def _count(ops: Column, holds) -> Column:
    return F.size(F.filter(ops, lambda o: holds(o))).cast("double")


def _counts(kinds: Column, names: Sequence[str]) -> list[Column]:
    """How often each name is in an array of names."""
    return [F.size(F.filter(kinds, _equals(n))).cast("double") for n in names]


def _equals(name: str):
    return lambda k: k == name


def offspring(block: Column) -> Column:
    """Targets of a block: jump and fail unless 0 (an absent one is -1 and counts), and switch cases."""
    cases = F.coalesce(F.size(block["switchop"]["cases"]), F.lit(0))
    cases = F.when(block["switchop"].isNull() | (cases < 0), 0).otherwise(cases)
    return ((block["fail"] != 0).cast("int") + (block["jump"] != 0).cast("int") + cases).cast("double")


def _known(arch: Column, vector: Column) -> Column:
    """Null for an architecture without opcode lists."""
    return F.when(arch.isin(list(ARCHITECTURES)), vector)


def gemini(block: Column, arch: Column, reduced: bool = False) -> Column:
    """Calls, transfers, arithmetic (exclusive, in that order), instructions, constants, strings, offspring."""
    kind = lambda o: first_class([(n, in_class(o["code"], arch, n)) for n in ("call", "transfer", "arithmetic")], "")
    more = [] if reduced else [F.when(F.size(block["ops"]) > 0, offspring(block)).otherwise(0.0)]

    def of(ops: Column) -> Column:
        out = once(F.transform(ops, kind), lambda kinds: F.array(*_counts(kinds, ("call", "transfer", "arithmetic"))))
        return F.concat(out, F.array(F.size(ops).cast("double"), _count(ops, lambda o: o["number"]), _count(ops, lambda o: o["string"]), *more))

    return _known(arch, once(_ops(block), of))


def dgis(block: Column, arch: Column) -> Column:
    """Eight exclusive counts; a call counts as one only if it is a library call."""
    order = ("stack", "arithmetic", "logic", "compare", "call", "unconditional", "conditional")

    def kind(o: Column) -> Column:
        return first_class([(n, in_class(o["code"], arch, n) & o["lib"] if n == "call" else in_class(o["code"], arch, n)) for n in order], "generic")

    return _known(arch, once(F.transform(_ops(block), kind), lambda kinds: F.array(*_counts(kinds, (*order, "generic")))))


def tiknib(block: Column, arch: Column) -> Column:
    """Seven overlapping counts."""
    def member(names: Sequence[str]):
        return lambda o: in_group(o["code"], arch, names)

    return _known(arch, once(_ops(block), lambda ops: F.array(*[_count(ops, member(names)) for names in OVERLAPPING.values()], F.size(ops).cast("double"))))


def features(block: Column, arch: Column, kind: str) -> Column:
    """Feature vector of a block: array of double."""
    if kind not in FEATURES:
        raise ValueError(f"unknown feature set {kind!r}: one of {', '.join(FEATURES)}")
    if kind in ("gemini", "discovre"):
        return gemini(block, arch, kind == "discovre")
    return dgis(block, arch) if kind == "dgis" else tiknib(block, arch)


def named(vector: Column, kind: str) -> Column:
    """Vector as a struct of named features."""
    return F.struct(*[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(FEATURES[kind])])


def vector_of(node: Column, kind: str) -> Column:
    """Struct of named features as a vector."""
    return F.array(*[node[n].cast("double") for n in FEATURES[kind]])


def n_instructions(block: Column, with_cases: bool = True) -> Column:
    cases = F.coalesce(F.size(block["switchop"]["cases"]), F.lit(0))
    return F.size(block["ops"]) + (F.greatest(cases, F.lit(0)) if with_cases else F.lit(0))


def detect_architecture(functions: DataFrame, by: str = "binary") -> DataFrame:
    """by, arch: of the first call in function, block and operation order whose mnemonic is known; else null.

    Each function finds its own first one; the functions of a binary combine by a minimum
    of their numbers, partially before the shuffle. Needs columns func_idx and blocks.
    """
    word = lambda o: F.regexp_extract(F.coalesce(o["disasm"], F.lit("")), r"(\S+)", 1)
    calls = F.filter(F.flatten(F.transform("blocks", lambda b: b["ops"])), lambda o: o["type"].isin("call", "rcall"))
    known = F.filter(F.transform(calls, lambda o: first_class([(a, word(o).isin(CLASSES[a]["call"])) for a in ARCHITECTURES])), lambda a: a.isNotNull())
    rows = functions.select(by, "func_idx", F.get(known, F.lit(0)).alias("arch"))
    best = F.min(F.when(F.col("arch").isNotNull(), F.struct("func_idx", "arch")))
    return rows.groupBy(by).agg(best.alias("best")).select(by, F.col("best.arch").alias("arch"))


def class_counts(ops: DataFrame, keys: Sequence[str], rules: Rules, other: str | None = None) -> DataFrame:
    """Flat form of the exclusive counts: keys, a count for each rule and for `other`, and n_total."""
    names = [n for n, _ in rules] + ([other] if other else [])
    kind = ops.select(*keys, first_class(rules, other).alias("__class"))
    return kind.groupBy(*keys).agg(*[F.count_if(F.col("__class") == n).alias(f"n_{n}") for n in names], F.count("*").alias("n_total"))


def overlapping_counts(ops: DataFrame, keys: Sequence[str], rules: Rules) -> DataFrame:
    """Flat form of the overlapping counts."""
    return ops.groupBy(*keys).agg(*[F.count_if(holds).alias(f"n_{n}") for n, holds in rules], F.count("*").alias("n_total"))

"""Queries that hand orders as disassembled functions to the operators: a line is a block of one instruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.operators import blocks, corpus, graphs, metadata
from gantry.plans import texts
from gantry.plans.rows import _table
from gantry.sources import readers

_SORTS = texts._SORTS
#: Binaries that the functions are dealt to.
BINARIES = 500


def _functions(spark: SparkSession, d: str, esil: bool = False) -> DataFrame:
    """binary, func_idx, name, arch, blocks; ESIL texts on demand.

    A block jumps to the next line's (the last to the first, one in four nowhere) and fails to
    the one that its part names, which may lie outside. The third line is a call in the words
    of the order's architecture.
    """
    call = F.element_at(F.array(F.lit("call"), F.lit("bl"), F.lit("jal")), (F.col("l_orderkey") % 3 + 1).cast("int"))

    # Texts are made of an order's lines, after the shuffle, which so carries numbers only.
    lines = F.array_sort(F.collect_list(F.struct(*_SORTS)))
    each = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("x")).withColumn("n", F.size("x"))

    def block(x, i):
        text = F.when(x["l_linenumber"] == 3, F.concat(call, F.lit(" sym.imp.f"), x["l_suppkey"].cast("string"))).otherwise(texts._instruction(lambda c: x[c]))
        kind = F.when(x["l_quantity"] > 45, "invalid").when(x["l_linenumber"] == 3, "call").otherwise("mov")
        raw = texts._esil(lambda c: x[c]) if esil else F.lit(None).cast("string")
        ops = F.transform(F.array(text), lambda t: F.struct(kind.alias("type"), t.alias("opcode"), t.alias("disasm"), raw.alias("esil")))
        jump = F.when(x["l_suppkey"] % 4 != 0, 100 + (i + 1) % F.col("n") * 10).otherwise(-1)
        none = F.lit(None).cast("struct<cases:array<int>>")
        return F.struct((100 + i * 10).cast("bigint").alias("offset"), jump.cast("bigint").alias("jump"), (100 + x["l_partkey"] % 9 * 10).cast("bigint").alias("fail"), none.alias("switchop"), ops.alias("ops"))

    key = F.col("l_orderkey")
    arch = F.element_at(F.array(*map(F.lit, ("X86", "ARM", "MIPS"))), (key % 3 + 1).cast("int"))
    # One row, generated: conditions on the blocks are not pushed below, where each would build them anew.
    return each.select((key % BINARIES).alias("binary"), key.alias("func_idx"), F.concat(F.lit("f"), key.cast("string")).alias("name"), arch.alias("arch"), F.explode(F.array(F.transform("x", block))).alias("blocks"))


def attributed_cfg(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the attributed control-flow graphs with their features and neighbours."""
    g = graphs.attributed_cfg(_functions(spark, d), "gemini", 3)
    nodes = g.select("binary", "name", "graph.adjacency", F.posexplode("graph.nodes").alias("id", "node"))
    near = F.array_join(F.transform(F.get("adjacency", F.col("id")), lambda a: a["id"].cast("string")), " ")
    return nodes.select("binary", "name", "id", near.alias("neighbours"), *[F.col(f"node.{n}").cast("bigint").alias(n) for n in blocks.FEATURES["gemini"]])


def architectures(spark: SparkSession, d: str) -> DataFrame:
    return blocks.detect_architecture(_functions(spark, d))


def tiknib_functions(spark: SparkSession, d: str) -> DataFrame:
    out = metadata.tiknib_functions(_functions(spark, d))
    return out.select("binary", "func_idx", "name", "features.*")


def disasm_strings(spark: SparkSession, d: str) -> DataFrame:
    return corpus.function_strings(_functions(spark, d), "disasm", 2)


def esil_strings(spark: SparkSession, d: str) -> DataFrame:
    return corpus.function_strings(_functions(spark, d, True), "esil", 2)


def instruction_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.linear_walk(_functions(spark, d), "instructions", 2)


def instruction_counts(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d).select("func_idx", F.transform("blocks", lambda b: blocks.n_instructions(b)).alias("n"))
    return f.select("func_idx", F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("n_instructions"))


def walk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts along the bounded walk from each block; no SQL, tested against brute force."""
    return corpus.walk_lines(_functions(spark, d), "instructions", 2)


def cfg_scan(spark: SparkSession, d: str) -> DataFrame:
    """Functions of control-flow documents: jumps may be missing or no number."""
    jump = lambda b: F.when(b["jump"] == -1, F.lit(None)).when(b["jump"] == 100, F.lit("18446744073709551615")).otherwise(b["jump"].cast("string"))
    body = F.transform("blocks", lambda b: F.struct(b["offset"].alias("offset"), jump(b).alias("jump"), F.when(b["fail"] < 150, b["fail"]).alias("fail"), b["ops"].alias("ops")))
    each = _functions(spark, d).select("binary", "func_idx", F.array(F.struct("name", body.alias("blocks"))).alias("f"))
    files = each.groupBy("binary").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("func_idx", "f"))), lambda x: x["f"])).alias("document"))
    rows = readers.parse(files.select(F.concat(F.lit("/in/b"), F.col("binary").cast("string"), F.lit("_cfg.json")).alias("path"), "document"), "cfg")
    flat = rows.select("binary", "func_idx", "name", F.posexplode("blocks").alias("place", "b"))
    return flat.select("binary", "func_idx", "name", "place", "b.offset", "b.jump", "b.fail", F.get("b.ops", F.lit(0))["disasm"].alias("disasm"))


# Mnemonics, and whether they do arithmetic or shift, and transfer control, if only on a condition.
CLASSED = [
    ("X86", "movsq", 0, 0), ("X86", "stosq", 0, 0), ("X86", "rep", 0, 1), ("X86", "je", 0, 1), ("X86", "jmp", 0, 1), ("X86", "add", 1, 0), ("X86", "mov", 0, 0),
    ("ARM", "add", 1, 0), ("ARM", "bl", 0, 1), ("ARM", "beq", 0, 1), ("ARM", "mov", 0, 0), ("MIPS", "addu", 1, 0), ("MIPS", "beq", 0, 1), ("MIPS", "lw", 0, 0),
]
# Mnemonics, and whether they are in the exclusive class of arithmetic.
ARITHMETIC = [
    ("X86", "add", 1), ("X86", "call", 0), ("ARM", "addeq", 1), ("ARM", "addmi", 0), ("ARM", "rsbmi", 1), ("ARM", "rsbeq", 0), ("ARM", "smla", 1), ("ARM", "smlabb", 0), ("ARM", "smlabbeq", 1),
    ("ARM", "umul", 1), ("ARM", "smlaltble", 1), ("ARM", "smlaltbcs", 0), ("ARM", "subeqs", 1), ("ARM", "ssatne16", 1), ("ARM", "mov", 0), ("MIPS", "addu", 1),
]


def _of_parts(spark: SparkSession, d: str, words: list[tuple]) -> DataFrame:
    """Each part with the mnemonic of its number."""
    listed = F.array(*[F.struct(F.lit(a).alias("arch"), F.lit(w).alias("code")) for a, w, *_ in words])
    return _table(spark, d, "part").select("p_partkey", F.get(listed, (F.col("p_partkey") % len(words)).cast("int")).alias("w")).select("p_partkey", "w.*")


def _one(code) -> F.Column:
    return F.struct(F.array(F.struct(F.lit("x").alias("type"), code.alias("opcode"), code.alias("disasm"))).alias("ops"), F.lit(0).alias("jump"), F.lit(0).alias("fail"), F.lit(None).cast("struct<cases:array<int>>").alias("switchop"))


def opcode_groups(spark: SparkSession, d: str) -> DataFrame:
    v = blocks.tiknib(_one(F.col("code")), F.col("arch"))
    at = lambda n: F.get(v, F.lit(blocks.TIKNIB.index(n))).cast("int").alias(n)
    return _of_parts(spark, d, CLASSED).select("p_partkey", "arch", "code", at("arithshift"), at("ctransfercond"))


def opcode_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    v = blocks.gemini(_one(F.col("code")), F.col("arch"))
    return _of_parts(spark, d, ARITHMETIC).select("p_partkey", "arch", "code", F.get(v, F.lit(2)).cast("int").alias("arithmetic"))


QUERIES = {f.__name__: f for f in (attributed_cfg, architectures, tiknib_functions, disasm_strings, esil_strings, instruction_lines, instruction_counts, walk_lines, cfg_scan, opcode_groups, opcode_arithmetic)}

_ORDERED = ", ".join(_SORTS)
_CALL = "CASE l_orderkey % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'bl' ELSE 'jal' END || ' sym.imp.f' || l_suppkey"
_LINES = f"""
    l AS (SELECT *, CASE WHEN l_linenumber = 3 THEN {_CALL} ELSE {texts._INSTRUCTION} END AS dis, {texts._ESIL} AS raw_esil FROM lineitem),
    b AS (SELECT l_orderkey % {BINARIES} AS program, l_orderkey AS func_idx, 'f' || l_orderkey AS name, CASE l_orderkey % 3 WHEN 0 THEN 'X86' WHEN 1 THEN 'ARM' ELSE 'MIPS' END AS arch, dis, raw_esil,
        CASE WHEN l_quantity > 45 THEN 'invalid' WHEN l_linenumber = 3 THEN 'call' ELSE 'mov' END AS kind, CASE WHEN l_quantity <= 45 THEN string_split(dis, ' ')[1] END AS code,
        row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey % 4 <> 0 AS jumps, l_partkey % 9 AS fails
        FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDERED})),
    t AS (SELECT *, CASE WHEN jumps THEN (i + 1) % n END AS to_jump, CASE WHEN fails < n THEN fails END AS to_fail FROM b)"""
_COUNT = "CASE WHEN code IS NOT NULL AND {} THEN 1 ELSE 0 END"
_GEMINI = ", ".join(f'({_COUNT.format(x)})::BIGINT AS "{n}"' for n, x in texts._GEMINI)
_VECTOR = ", ".join(f"{_COUNT.format(x)} AS {n}" for n, x in [*((n, texts._group(*groups)) for n, groups in blocks.OVERLAPPING.items()), ("total", "true")])
_AVERAGES = ", ".join(f"(sum({'arithshift' if n == 'compare' else n})::FLOAT / count(*)::FLOAT)::FLOAT AS avg_{n}" for n in blocks.TIKNIB)
_SUMS = ", ".join(f"sum({n})::FLOAT AS sum_{n}" for n in blocks.TIKNIB)
_DISASM = texts._sql_rewritten(texts._SPACED.format("dis"), texts.normalise.DISASM_PATTERNS)
_ESIL = f"regexp_replace({texts._sql_rewritten('raw_esil', texts.normalise.ESIL_PATTERNS)}, '[0-9]{{4,}}?,', CASE WHEN kind = 'call' THEN 'FUNC,' ELSE 'DATA,' END, 'g')"


def _strings(text: str) -> str:
    return f"WITH {_LINES}, s AS (SELECT *, {text} AS x FROM b WHERE n >= 2) SELECT program, func_idx, name, string_agg(replace(x, ',', ' '), ' ' ORDER BY i) AS text FROM s WHERE x <> '' GROUP BY ALL"


def _values(words: list[tuple], names: str) -> str:
    rows = ", ".join(f"({i}, {', '.join(repr(x) for x in w)})" for i, w in enumerate(words))
    return f"SELECT p_partkey, {names} FROM part JOIN (VALUES {rows}) AS v(k, {names}) ON p_partkey % {len(words)} = k"


ORACLE_SQL = {
    "attributed_cfg": f"""WITH {_LINES},
        g AS (SELECT name FROM t GROUP BY name HAVING max(n) >= 3 AND count(to_jump) + count(to_fail) > 0 AND max(greatest(CASE WHEN to_jump IS NOT NULL OR to_fail IS NOT NULL THEN i END, to_jump, to_fail)) + 1 = max(n))
        SELECT program, name, i::INT AS id, concat_ws(' ', to_fail, to_jump) AS neighbours, {_GEMINI}, 2::BIGINT AS "numOffspring" FROM t JOIN g USING (name)""",
    "architectures": f"WITH {_LINES} SELECT program, arg_min(arch, (func_idx, i)) FILTER (kind = 'call') AS arch FROM b GROUP BY program",
    "tiknib_functions": f"WITH {_LINES}, v AS (SELECT program, func_idx, name, {_VECTOR} FROM b) SELECT program, func_idx, name, {_AVERAGES}, {_SUMS} FROM v GROUP BY 1, 2, 3",
    "disasm_strings": _strings(_DISASM),
    "esil_strings": _strings(_ESIL),
    "instruction_lines": f"WITH {_LINES} SELECT program, func_idx, name, i::INT AS ord, {_DISASM} AS text FROM b WHERE n >= 2",
    "instruction_counts": "SELECT l_orderkey AS func_idx, count(*)::INT AS n_instructions FROM lineitem GROUP BY 1",
    "cfg_scan": f"""WITH {_LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY func_idx) - 1 AS place_in_file FROM (SELECT DISTINCT program, func_idx FROM b))
        SELECT 'b' || t.program AS program, place_in_file::INT AS func_idx, name, i::INT AS place, 100 + i * 10 AS "offset", CASE WHEN to_jump IS NULL THEN -1 WHEN to_jump = 0 THEN 0 ELSE 100 + to_jump * 10 END AS jump,
        CASE WHEN fails < 5 THEN 100 + fails * 10 ELSE -1 END AS fail, dis AS disasm FROM t JOIN p ON p.func_idx = t.func_idx""",
    "opcode_groups": _values(CLASSED, "arch, code, arithshift, ctransfercond"),
    "opcode_arithmetic": _values(ARITHMETIC, "arch, code, arithmetic"),
}

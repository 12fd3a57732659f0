"""Queries on instruction texts: normalisation, function strings, walks, pairs, pre-tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions import normalise, text
from gantry.functions.opcodes import ARCHITECTURES, CLASSES, GROUPS, OVERLAPPING
from gantry.operators import blocks, corpus, tokeniser
from gantry.plans.rows import _sentences, _table

_SORTS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _hex(c):
    return F.lower(F.hex((F.col(c) if isinstance(c, str) else c).cast("bigint")))


def _instruction(of=F.col) -> F.Column:
    """A line as disassembly: its numbers, columns or what `of` gives by name, stand in for registers, immediates and addresses."""
    number = of("l_linenumber")
    return (
        F.when(number == 1, F.concat(F.lit("mov eax, 0x"), _hex(of("l_partkey"))))
        .when(number == 2, F.concat(F.lit("lea rdi, [rbp - 0x"), F.hex(of("l_quantity").cast("bigint")), F.lit("]")))
        .when(number == 3, F.concat(F.lit("call sym.imp.f"), of("l_suppkey").cast("string")))
        .when(number == 4, F.concat(F.lit("lw a0, 0x"), _hex(of("l_quantity")), F.lit("(sp)")))
        .when(number == 5, F.concat(F.lit("mov rsi, str.name_"), of("l_partkey").cast("string")))
        .when(number == 6, F.concat(F.lit("cmp dword [rax*8], 0xffffff"), _hex(of("l_quantity"))))
        .otherwise(F.concat(F.lit("nop word cs:[rax + r8*"), of("l_suppkey").cast("string"), F.lit("]")))
    )


def _esil(of=F.col) -> F.Column:
    return F.concat(F.lit("0x"), _hex(of("l_partkey")), F.lit(",rax,+,"), (F.col("l_orderkey") + 1000).cast("string"), F.lit(",eax,=,[4],0xffffff"), _hex(of("l_quantity")), F.lit(",a7,-="))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem")


def normalise_disasm(spark: SparkSession, d: str) -> DataFrame:
    out = normalise.disasm(_instruction(), unicode=False)
    return _lines(spark, d).groupBy("l_linenumber", out.alias("text")).agg(F.count("*").alias("n"))


def mask_registers(spark: SparkSession, d: str) -> DataFrame:
    out = normalise.disasm(_instruction(), registers=True, unicode=False)
    return _lines(spark, d).groupBy("l_linenumber", out.alias("text")).agg(F.count("*").alias("n"))


def normalise_esil(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "call").otherwise("mov")
    return _lines(spark, d).groupBy("l_returnflag", normalise.esil(_esil(), kind).alias("text"), normalise.esil(_esil(), kind, True).alias("masked")).agg(F.count("*").alias("n"))


def normalise_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents on one line, normalised; by digest."""
    one = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    out = normalise.disasm(F.regexp_replace(one, "[^\\x20-\\x7E]", "?"), unicode=False)
    return _table(spark, d, "documents").select("doc_id", F.sha2(out, 256).alias("digest"), F.length(out).cast("bigint").alias("n_chars"))


def function_string(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns in order, as one text with commas as spaces."""
    c = _table(spark, d, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.filter("octet_length(text) > 1").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: F.translate(x["text"], ",", " ")), " ").alias("text"))


def string_map(spark: SparkSession, d: str) -> DataFrame:
    """The last text of each role in each conversation, exploded from one map a conversation."""
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("binary"), F.col("role").alias("name"), F.col("turn").alias("func_idx"), "text")
    return corpus.string_map(c).select("binary", F.explode("strings").alias("name", "text"))


def linear_walk(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("conv_id", "turn", "ord", "sentence")


def line_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a tool's output: instructions and p-code of each order."""
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("0x"), _hex("l_partkey"), F.lit("  push "))).otherwise(F.concat(F.lit("  COPY "), F.col("l_partkey").cast("string")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*_SORTS, line.alias("line")))), lambda x: x["line"])
    each = _lines(spark, d).groupBy("l_orderkey").agg(lines.alias("lines"))
    return each.select("l_orderkey", F.array_join(text.assembly_lines(F.col("lines")), "\n").alias("asm"), F.array_join(text.pcode_lines(F.col("lines")), "\n").alias("pcode"))


def instruction_pairs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.row_pairs(_sentences(spark, d), ["conv_id", "turn"], ["ord"], "sentence")


def pcode_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring lines of an order, in arrays: no window."""
    sides = F.transform(F.array_sort(F.collect_list(F.struct(*_SORTS))), lambda x: x["l_partkey"].cast("string"))
    each = _lines(spark, d).groupBy("l_orderkey").agg(sides.alias("lines"))
    return each.select("l_orderkey", F.posexplode(corpus.pairs(F.col("lines"), corpus.PCODE_PAIR)).alias("ord", "pair"))


def dfs_walk(spark: SparkSession, d: str) -> DataFrame:
    """Bounded depth-first walks over each order's lines: a line leads to the next, and to the one that its size names."""
    lines = F.array_sort(F.collect_list(F.struct(*_SORTS)))
    each = _lines(spark, d).groupBy("l_orderkey").agg(lines.alias("x")).withColumn("n", F.size("x"))
    nexts = F.transform("x", lambda x, i: F.struct(i.alias("src"), ((i + 1) % F.col("n")).cast("int").alias("dst")))
    jumps = F.transform("x", lambda x, i: F.struct(i.alias("src"), (x["l_partkey"] % F.col("n")).cast("int").alias("dst")))
    walked = corpus.with_walks(each.select("l_orderkey", F.concat(nexts, jumps).alias("edges"), "n"), F.col("edges"), F.col("n"))
    return walked.select("l_orderkey", F.posexplode("walks").alias("start", "walk")).select("l_orderkey", "start", F.array_join(F.transform("walk", lambda i: i.cast("string")), " ").alias("walk"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as basic blocks of the instructions of their lines, on three architectures."""
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("call 0x"), _hex("l_partkey"), F.lit(" ; imp"))).otherwise(_instruction())
    kind = F.when(F.col("l_quantity") > 45, "invalid").when(F.col("l_linenumber") == 7, "nop").otherwise("mov")
    ops = F.collect_list(F.struct(kind.alias("type"), text.alias("opcode"), text.alias("disasm")))
    number = F.col("l_orderkey")
    each = _lines(spark, d).groupBy("l_orderkey").agg(ops.alias("ops"))
    arch = F.when(number % 4 == 0, "X86").when(number % 4 == 1, "ARM").when(number % 4 == 2, "MIPS")
    switch = F.when(number % 5 == 0, F.struct(F.array(F.lit(1), F.lit(2)).alias("cases")))
    return each.select("l_orderkey", arch.alias("arch"), F.struct("ops", (number % 3).alias("jump"), F.lit(-1).alias("fail"), switch.alias("switchop")).alias("block"))


def _features(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        vector = _blocks(spark, d).select("l_orderkey", blocks.features(F.col("block"), F.col("arch"), kind).alias("v"))
        return vector.select("l_orderkey", *[F.get("v", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(blocks.FEATURES[kind])])

    return query


def bpe_pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of lower-case words and blanks: texts reduced to letters that every engine classes alike."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 ]", " ")
    return tokeniser.pretoken_counts(_table(spark, d, "documents").select(plain.alias("text")))


def bpe_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of the documents' texts, of the default size."""
    vocabulary, _ = tokeniser.learn(_table(spark, d, "documents"))
    return spark.createDataFrame(sorted(vocabulary.items(), key=lambda x: x[1]), "token string, id int")


QUERIES = {f.__name__: f for f in (normalise_disasm, mask_registers, normalise_esil, normalise_documents, function_string, string_map, linear_walk, line_split, instruction_pairs, pcode_pairs, dfs_walk, bpe_pretoken_counts, bpe_vocab)}
QUERIES |= {f"{k}_features": _features(k) for k in blocks.FEATURES}


def _sql_rewritten(column: str, patterns: list[tuple[str, str]]) -> str:
    for p, r in patterns:
        column = f"regexp_replace({column}, '{p.replace(chr(39), chr(39) * 2)}', '{r}', 'g')"
    return column


_HEX = "lower(hex({}::BIGINT))"
_INSTRUCTION = f"""CASE l_linenumber WHEN 1 THEN 'mov eax, 0x' || {_HEX.format("l_partkey")} WHEN 2 THEN 'lea rdi, [rbp - 0x' || hex(l_quantity::BIGINT) || ']'
    WHEN 3 THEN 'call sym.imp.f' || l_suppkey WHEN 4 THEN 'lw a0, 0x' || {_HEX.format("l_quantity")} || '(sp)' WHEN 5 THEN 'mov rsi, str.name_' || l_partkey
    WHEN 6 THEN 'cmp dword [rax*8], 0xffffff' || {_HEX.format("l_quantity")} ELSE 'nop word cs:[rax + r8*' || l_suppkey || ']' END"""
_SPACED = "replace(replace({}, ',', ' '), '  ', ' ')"
_DISASM = _sql_rewritten(_SPACED.format("i"), normalise.DISASM_PATTERNS)
_ESIL = f"'0x' || {_HEX.format('l_partkey')} || ',rax,+,' || (l_orderkey + 1000) || ',eax,=,[4],0xffffff' || {_HEX.format('l_quantity')} || ',a7,-='"
_ONE_LINE = r"regexp_replace(translate(coalesce(text, ''), chr(10) || chr(13), '  '), '[^\x20-\x7E]', '?', 'g')"
_ORDERED = ", ".join(_SORTS)
_SENTENCES = "SELECT conv_id, turn, lower(unnest(string_split(translate(text, chr(10), ' '), '. '))) AS sentence, unnest(range(len(string_split(translate(text, chr(10), ' '), '. '))))::INT AS ord FROM conversations"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_R32, _R64, _FP, _RISCV = map(_quoted, (normalise.REGISTERS_32, normalise.REGISTERS_64, normalise.FRAME_POINTERS, normalise.REGISTERS_RISCV))
_MASK = f"""CASE WHEN list_contains({_FP}, t) THEN 'fp' WHEN list_contains({_R32}, t) THEN 'reg32' WHEN list_contains({_R64}, t) THEN 'reg64'
    WHEN t[1] = '[' AND t[-1] = ']' THEN CASE WHEN list_contains({_R32}, t[2:-2]) THEN '[reg32]' WHEN list_contains({_R64}, t[2:-2]) THEN '[reg64]' ELSE t END
    WHEN t[1] = '[' THEN CASE WHEN list_contains({_R32}, t[2:]) THEN '[reg32' WHEN list_contains({_R64}, t[2:]) THEN '[reg64' ELSE t END
    WHEN contains(t, '*') THEN array_to_string(list_transform(string_split(t, '*'), lambda p: CASE WHEN list_contains({_R64}, p) THEN 'reg64' ELSE p END), '*') ELSE t END"""

#: The mnemonics that the lines have, and which of them are in a class.
_CODES = ("mov", "lea", "call", "bl", "jal", "lw", "cmp", "nop")


def _in(lists: list[tuple[str, list[str]]]) -> str:
    """Whether an operation's code is in the lists of its architecture."""
    return "(" + " OR ".join(f"(arch = '{a}' AND list_contains({_quoted([c for c in _CODES if c in words])}::VARCHAR[], code))" for a, words in lists) + ")"


def _class(*names: str) -> str:
    return _in([(a, [w for n in names for w in CLASSES[a][n]]) for a in ARCHITECTURES])


def _group(*names: str) -> str:
    return _in([(a, [w for n in names for w in GROUPS[a][n]]) for a in ARCHITECTURES])


_OPS = f"""
    t AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'call 0x' || {_HEX.format("l_partkey")} || ' ; imp' ELSE {_INSTRUCTION} END AS dis FROM lineitem),
    o AS (SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN 'X86' WHEN 1 THEN 'ARM' WHEN 2 THEN 'MIPS' END AS arch, dis,
        CASE WHEN l_quantity > 45 THEN NULL WHEN l_linenumber = 7 THEN 'nop' ELSE string_split(dis, ' ')[1] END AS code FROM t)"""


def _counted(kinds: list[tuple[str, str]], more: str = "") -> str:
    """Counts of operations with a code by condition; nothing for an unknown architecture."""
    known = "CASE WHEN any_value(arch) IS NOT NULL THEN {} END::BIGINT AS \"{}\""
    return f"WITH {_OPS} SELECT l_orderkey, {', '.join(known.format(f'count(*) FILTER (code IS NOT NULL AND {x})', n) for n, x in kinds)}{more} FROM o GROUP BY l_orderkey"


_GEMINI = [("numCalls", _class("call")), ("numTransfer", f"{_class('transfer')} AND NOT {_class('call')}"), ("numArith", f"{_class('arithmetic')} AND NOT {_class('transfer', 'call')}"), ("numIns", "true"), ("numericConsts", "contains(dis, ', 0x')"), ("stringConsts", "contains(dis, ' str.')")]
_OFFSPRING = ", CASE WHEN any_value(arch) IS NOT NULL THEN 1 + (l_orderkey % 3 <> 0)::INT + CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 0 END END::BIGINT AS \"numOffspring\""
_DGIS_ORDER = [("numStackOps", _class("stack")), ("numArithOps", _class("arithmetic")), ("numLogicOps", _class("logic")), ("numCmpOps", _class("compare")), ("numLibCalls", f"({_class('call')} AND contains(dis, 'imp'))"), ("numUnconJumps", _class("unconditional")), ("numConJumps", _class("conditional"))]
_DGIS = [(n, x + "".join(f" AND NOT {y}" for _, y in _DGIS_ORDER[:i])) for i, (n, x) in enumerate(_DGIS_ORDER)]
_DGIS.append(("numGenericIns", "true" + "".join(f" AND NOT {y}" for _, y in _DGIS_ORDER)))

ORACLE_SQL = {
    "gemini_features": _counted(_GEMINI, _OFFSPRING),
    "discovre_features": _counted(_GEMINI),
    "dgis_features": _counted(_DGIS),
    "tiknib_features": _counted([*((n, _group(*groups)) for n, groups in OVERLAPPING.items()), ("total", "true")]),
    "normalise_disasm": f"WITH x AS (SELECT l_linenumber, {_INSTRUCTION} AS i FROM lineitem) SELECT l_linenumber, {_DISASM} AS text, count(*) AS n FROM x GROUP BY ALL",
    "mask_registers": f"""
        WITH x AS (SELECT l_linenumber, {_INSTRUCTION} AS i FROM lineitem), y AS (SELECT l_linenumber, {_DISASM} AS i, count(*) AS n FROM x GROUP BY ALL)
        SELECT l_linenumber, array_to_string(list_transform(list_filter(string_split(i, ' '), lambda t: t <> ''), lambda t: {_MASK}), ' ') AS text, sum(n)::BIGINT AS n FROM y GROUP BY 1, 2""",
    "normalise_esil": f"""
        WITH x AS (SELECT l_returnflag, {_sql_rewritten(_ESIL, normalise.ESIL_PATTERNS)} AS e FROM lineitem),
        y AS (SELECT l_returnflag, regexp_replace(e, '[0-9]{{4,}}?,', CASE WHEN l_returnflag = 'R' THEN 'FUNC,' ELSE 'DATA,' END, 'g') AS text, count(*) AS n FROM x GROUP BY ALL)
        SELECT l_returnflag, text, array_to_string(list_transform(list_filter(string_split(text, ','), lambda t: t <> ''), lambda t: CASE WHEN list_contains({_R32}, t) OR list_contains({_RISCV}, t) THEN 'reg32' WHEN list_contains({_R64}, t) THEN 'reg64' ELSE t END), ' ') AS masked, sum(n)::BIGINT AS n FROM y GROUP BY ALL""",
    "normalise_documents": f"WITH x AS (SELECT doc_id, {_ONE_LINE} AS i FROM documents), y AS (SELECT doc_id, {_DISASM} AS o FROM x) SELECT doc_id, sha256(o) AS digest, length(o)::BIGINT AS n_chars FROM y",
    "function_string": "SELECT conv_id, string_agg(replace(text, ',', ' '), ' ' ORDER BY turn, role, text) AS text FROM conversations WHERE strlen(text) > 1 GROUP BY 1",
    "string_map": "SELECT conv_id AS program, role AS name, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2",
    "linear_walk": f"SELECT conv_id, turn, ord, sentence FROM ({_SENTENCES})",
    "line_split": f"""SELECT l_orderkey, coalesce(string_agg('0x' || {_HEX.format("l_partkey")} || '  push', chr(10) ORDER BY {_ORDERED}) FILTER (l_returnflag = 'R'), '') AS asm,
        coalesce(string_agg('COPY ' || l_partkey, chr(10) ORDER BY {_ORDERED}) FILTER (l_returnflag <> 'R'), '') AS pcode FROM lineitem GROUP BY 1""",
    "instruction_pairs": f"WITH s AS ({_SENTENCES}), p AS (SELECT conv_id, turn, ord, sentence || '      ' || lead(sentence) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS pair FROM s) SELECT * FROM p WHERE pair IS NOT NULL",
    "pcode_pairs": f"WITH p AS (SELECT l_orderkey, (row_number() OVER w - 1)::INT AS ord, l_partkey || ' ---- ' || lead(l_partkey) OVER w AS pair FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDERED})) SELECT * FROM p WHERE pair IS NOT NULL",
    "bpe_pretoken_counts": r"""
        WITH t AS (SELECT trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g')) AS t FROM documents),
        r AS (SELECT unnest(regexp_extract_all(' ' || t, '[a-z]+|[0-9]+| +')) AS r, unnest(range(len(regexp_extract_all(' ' || t, '[a-z]+|[0-9]+| +')))) AS i, row_number() OVER () AS d FROM t WHERE t <> ''),
        n AS (SELECT r, lag(r) OVER (PARTITION BY d ORDER BY i) AS before FROM r),
        k AS (SELECT CASE WHEN r[1] <> ' ' THEN CASE WHEN before[1] = ' ' THEN ' ' || r ELSE r END WHEN length(r) > 1 THEN r[1:-2] END AS token FROM n)
        SELECT token, count(*) AS n FROM k WHERE token IS NOT NULL GROUP BY 1""",
}

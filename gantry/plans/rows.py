"""Queries on counts, metadata, dedup, paths and nested fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions import paths, text
from gantry.operators import blocks, dedup, metadata, pool

# Fixed values of the queries: first words of sentences that stand in for opcodes.
WORDS = {"call": ["the", "der", "le"], "transfer": ["of", "to", "de"], "arithmetic": ["is", "and", "en"], "compare": ["in", "for", "a"]}
GROUPS = {"large": "l_quantity >= 30", "cheap": "l_extendedprice < 20000", "returned": "l_returnflag = 'R'", "discounted": "l_discount > 0.05 or l_tax > 0.05"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(F.split(F.translate("text", "\n", " "), r"\. "), F.lower)
    return _table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words).alias("ord", "sentence"))


def _rules(code) -> list:
    return [(n, code.isin(w)) for n, w in WORDS.items()]


def block_class_counts(spark: SparkSession, d: str) -> DataFrame:
    ops = _sentences(spark, d).withColumn("code", blocks.opcode(F.lit(""), F.regexp_replace("sentence", "[^a-z ]", "")))
    return blocks.class_counts(ops.filter("code is not null"), ["conv_id", "turn"], _rules(F.col("code")), "generic")


def overlapping_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocks.overlapping_counts(_table(spark, d, "lineitem"), ["l_orderkey"], [(n, F.expr(x)) for n, x in GROUPS.items()])


def function_avg_sum(spark: SparkSession, d: str) -> DataFrame:
    counts = overlapping_counts(spark, d).join(_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return metadata.group_statistics(counts, ["o_custkey"], ["n_large", "n_total"])


def offspring(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    block = F.struct(F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size")).alias("jump"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(-1).alias("fail"), F.when(F.col("p_size") % 3 == 0, F.struct(F.split("p_name", " ").alias("cases"))).alias("switchop"))
    return part.select("p_partkey", blocks.offspring(block).cast("int").alias("n_offspring"))


def arch_detect(spark: SparkSession, d: str) -> DataFrame:
    """The type of a user's first purchase or error."""
    e = _table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type"))["event_type"].alias("arch"))


def finfo_subset(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    odd = lambda n, c: F.when(F.col("p_partkey") % n != 0, c)
    info = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("ninstrs"), (F.col("p_size") * 2).alias("edges"), odd(2, F.col("p_size")).alias("indegree"), odd(3, F.col("p_size")).alias("outdegree"), odd(5, F.col("p_size")).alias("nlocals"), odd(7, F.col("p_size")).alias("nargs"), F.col("p_type").alias("signature"))
    return metadata.subset(info, keep=["p_partkey"])


def finfo_extended(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    size = F.col("p_size")
    info = part.select("p_partkey", F.col("p_name").alias("name"), size.alias("ninstrs"), size.alias("edges"), size.alias("indegree"), F.lit(None).cast("int").alias("outdegree"), size.alias("nlocals"), size.alias("nargs"), (size % 4 + 1).alias("nbbs"))
    return metadata.subset(info, extended=True, keep=["p_partkey"])


def combo_zip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers at the same place within their nation."""

    def placed(name: str, p: str) -> DataFrame:
        own = F.sort_array(F.collect_list(F.struct(f"{p}_{name[:4]}key", f"{p}_name", f"{p}_acctbal")))
        each = _table(spark, d, name).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(own.alias("r"))
        return each.select("nation", F.posexplode("r").alias("place", "r")).select("nation", "place", F.col(f"r.{p}_name"), F.col(f"r.{p}_acctbal"))

    return metadata.zipped(placed("supplier", "s"), placed("customer", "c"), ["nation"], "place")


def node_features(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier with the first customer of its name's number, or the default row."""
    from gantry.operators.graphs import attach

    nodes = _table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("binary"), F.substring("s_name", -2, 2).alias("name"))
    meta = _table(spark, d, "customer").select(F.col("c_nationkey").alias("binary"), F.substring("c_name", -2, 2).alias("name"), F.col("c_custkey").alias("func_idx"), "c_mktsegment", "c_acctbal")
    return attach(nodes, meta, ["c_mktsegment", "c_acctbal"], {"c_mktsegment": "", "c_acctbal": 0.0})


def _strings(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("lang").alias("binary"), F.col("source").alias("name"), "text", F.col("doc_id").alias("path"))


def dedup_by_program(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_strings(_strings(spark, d)).select("binary", "name", "path")


def dedup_value_only(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_strings(_strings(spark, d), value_only=True).select("binary", "name", "path")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.statistics(_strings(spark, d), ["binary"], ["text"])


def dedup_graph(spark: SparkSession, d: str) -> DataFrame:
    """First order of a customer with the same set of supplier and flag pairs."""
    items = F.sort_array(F.collect_set(F.struct((F.col("l_suppkey") % 3).alias("id"), F.col("l_returnflag").alias("flag"))))
    graphs = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("graph"))
    rows = graphs.join(_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("binary"), "graph", F.col("o_orderkey").alias("path"))
    return dedup.dedup_graphs(rows).select("binary", "path", F.to_json("graph").alias("graph"))


def dedup_removed(spark: SparkSession, d: str) -> DataFrame:
    rows = _strings(spark, d)
    return dedup.duplicates(rows, dedup.dedup_strings(rows, value_only=True), ["path"]).select("binary", "path")


def program_names(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    folder = lambda *cols: F.concat(F.lit("/in/"), *cols, F.lit("_cg-onehopcg/sym.f.json"))
    number = F.col("p_partkey").cast("string")
    return part.select(
        "p_partkey",
        paths.program(folder(F.lit("x86-gcc-9-O3_"), name), "cisco").alias("cisco"),
        paths.program(folder(F.lit("a-1_gcc_x86_32_O3_"), name), "binkit").alias("binkit"),
        paths.program(folder(name, F.lit("-O2-"), number), "binarycorp").alias("binarycorp"),
        paths.save_path(F.concat(F.lit("/in/"), name, F.lit(".v"), number, F.lit("_cg.json")), "/out/", "json", "gcg", "_cg").alias("saved"),
        paths.sanitised(F.concat("p_name", F.lit("::f("), number, F.lit(")"))).alias("clean"),
        paths.stripped(F.concat("p_name", F.lit("::f(\""), number, F.lit("\")"))).alias("stripped"),
        paths.last_two(folder(name), "/kept").alias("kept"),
    )


def shortened_names(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", paths.shortened(F.repeat("url", F.lit(2))).alias("name"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages").withColumn("path", F.split("url", r"\?")[0])
    return pages.select("page_id", paths.file_name(F.col("path")).alias("file"), paths.parent(F.col("path")).alias("folder"), paths.last_two(F.col("path"), "/out").alias("moved"))


def files_sorted(spark: SparkSession, d: str) -> DataFrame:
    """All pages by path: the whole sorted file list."""
    return _table(spark, d, "pages").select("page_id", "url").orderBy("url", "page_id")


def map_explode(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.explode("m").alias("name", "value"))


def json_field(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", text.field(F.col("props"), "$.k").cast("bigint").alias("k"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Events' fields as the tool prints them: an array a line, empty arrays between."""
    one = F.concat(F.lit("["), F.col("props"), F.lit("]\n"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(one, one)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[]\n"), one)).otherwise(F.lit("[]\n"))
    return _table(spark, d, "events").select("event_id", text.repaired_json(raw).alias("fixed"))


def hex_decode(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    escaped = F.concat(F.lit("push "), F.regexp_replace(F.hex("p_name"), "(..)", r"\\x$1"), F.lit(" \\xz"))
    return part.select("p_partkey", text.hex_bytes(F.hex("p_name")).cast("string").alias("plain"), text.escaped_bytes(escaped).cast("string").alias("escaped"))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    out = pool.mean_pool(_table(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", "pos", F.round("mean", 6).alias("mean"))


def instruction_stats(spark: SparkSession, d: str) -> DataFrame:
    """Reads and writes of each key of a keyed document: returned and kept lines by supplier."""
    return _table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("reads"), F.count_if(F.col("l_returnflag") != "R").alias("writes"), F.count_distinct("l_partkey").alias("sites"))


QUERIES = {f.__name__: f for f in (block_class_counts, overlapping_counts, function_avg_sum, offspring, arch_detect, finfo_subset, finfo_extended, combo_zip, node_features, dedup_by_program, dedup_value_only, dedup_stats, dedup_graph, dedup_removed, program_names, shortened_names, path_parts, files_sorted, map_explode, json_field, json_repair, hex_decode, mean_pool, instruction_stats)}


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SENTENCES = "SELECT conv_id, turn, lower(unnest(string_split(translate(text, chr(10), ' '), '. '))) AS sentence, unnest(range(len(string_split(translate(text, chr(10), ' '), '. ')))) AS ord FROM conversations"
_CASES = " ".join(f"WHEN code IN ({_listed(w)}) THEN '{n}'" for n, w in WORDS.items())
_STRINGS = "SELECT lang AS program, source AS name, text, doc_id AS path FROM documents"
_NAME = "replace(p_name, ' ', '-')"

ORACLE_SQL = {
    "block_class_counts": f"""
        WITH s AS ({_SENTENCES}), o AS (SELECT conv_id, turn, regexp_extract(regexp_replace(sentence, '[^a-z ]', '', 'g'), '[^ ]+') AS code FROM s),
        c AS (SELECT conv_id, turn, CASE {_CASES} ELSE 'generic' END AS k FROM o WHERE code <> '')
        SELECT conv_id, turn, {", ".join(f"count(*) FILTER (k = '{n}') AS n_{n}" for n in [*WORDS, "generic"])}, count(*) AS n_total FROM c GROUP BY ALL""",
    "overlapping_counts": f"SELECT l_orderkey, {', '.join(f'count(*) FILTER ({x}) AS n_{n}' for n, x in GROUPS.items())}, count(*) AS n_total FROM lineitem GROUP BY l_orderkey",
    "function_avg_sum": f"""
        WITH c AS (SELECT l_orderkey, count(*) FILTER ({GROUPS["large"]}) AS n_large, count(*) AS n_total FROM lineitem GROUP BY 1)
        SELECT o_custkey, avg(n_large)::FLOAT AS avg_n_large, avg(n_total)::FLOAT AS avg_n_total, sum(n_large)::FLOAT AS sum_n_large, sum(n_total)::FLOAT AS sum_n_total
        FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "offspring": "SELECT p_partkey, (p_size % 7 <> 0)::INT + (p_size % 5 <> 0)::INT + CASE WHEN p_size % 3 = 0 THEN len(string_split(p_name, ' ')) ELSE 0 END::INT AS n_offspring FROM part",
    "arch_detect": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS arch FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1",
    "finfo_subset": """SELECT p_partkey, p_name AS name, p_size AS ninstrs, p_size * 2 AS edges, CASE WHEN p_partkey % 2 <> 0 THEN p_size ELSE 0 END AS indegree,
        CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS outdegree, CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 0 END AS nlocals, CASE WHEN p_partkey % 7 <> 0 THEN p_size ELSE 0 END AS nargs, p_type AS signature FROM part""",
    "finfo_extended": "SELECT p_partkey, p_name AS name, p_size AS ninstrs, p_size AS edges, p_size AS indegree, 0 AS outdegree, p_size AS nlocals, p_size AS nargs, p_size % 4 + 1 AS nbbs, (p_size::FLOAT / (p_size % 4 + 1)::FLOAT)::FLOAT AS avg_ins_bb FROM part",
    "combo_zip": """
        WITH s AS (SELECT *, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS place FROM supplier),
        c AS (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS place FROM customer)
        SELECT s_nationkey AS nation, s.place, s_name, s_acctbal, c_name, c_acctbal FROM s JOIN c ON s_nationkey = c_nationkey AND s.place = c.place""",
    "node_features": """
        WITH m AS (SELECT c_nationkey AS b, right(c_name, 2) AS n, arg_min(c_mktsegment, c_custkey) AS g, arg_min(c_acctbal, c_custkey) AS a FROM customer GROUP BY 1, 2)
        SELECT s_suppkey, s_nationkey AS program, right(s_name, 2) AS name, coalesce(g, '') AS c_mktsegment, coalesce(a, 0.0::DOUBLE) AS c_acctbal FROM supplier LEFT JOIN m ON b = s_nationkey AND n = right(s_name, 2)""",
    "dedup_by_program": f"SELECT program, name, min(path) AS path FROM ({_STRINGS}) GROUP BY program, name, text",
    "dedup_value_only": f"SELECT program, arg_min(name, path) AS name, min(path) AS path FROM ({_STRINGS}) GROUP BY program, text",
    "dedup_stats": f"""
        WITH g AS (SELECT program, count(*) AS before, count(DISTINCT text) AS after FROM ({_STRINGS}) GROUP BY 1)
        SELECT program, before, after, before - after AS removed, ((before - after)::FLOAT / before::FLOAT * 100::FLOAT)::FLOAT AS percent FROM g""",
    "dedup_graph": """
        WITH i AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS id, l_returnflag AS flag FROM lineitem),
        g AS (SELECT l_orderkey, '[' || string_agg('{"id":' || id || ',"flag":"' || flag || '"}', ',' ORDER BY id, flag) || ']' AS graph FROM i GROUP BY 1)
        SELECT o_custkey AS program, min(o_orderkey) AS path, graph FROM g JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, graph""",
    "dedup_removed": f"WITH s AS ({_STRINGS}), k AS (SELECT *, row_number() OVER (PARTITION BY program, text ORDER BY path) AS n FROM s) SELECT program, path FROM k WHERE n > 1",
    "program_names": f"""SELECT p_partkey, {_NAME} AS cisco, {_NAME} AS binkit, {_NAME} AS binarycorp, '/out/' || {_NAME} || '.v' || p_partkey || '-gcg.json' AS saved,
        regexp_replace(p_name || '::f(' || p_partkey || ')', '[^a-zA-Z0-9_.-]', '_', 'g') AS clean, replace(p_name || 'f' || p_partkey, '::', '') AS stripped, '/kept/' || {_NAME} || '_cg-onehopcg/sym.f.json' AS kept FROM part""",
    "shortened_names": "SELECT page_id, CASE WHEN length(url || url) > 100 THEN left(url || url, 75) ELSE url || url END AS name FROM pages",
    "path_parts": "WITH p AS (SELECT page_id, string_split(string_split(url, '?')[1], '/') AS x FROM pages) SELECT page_id, x[-1] AS file, x[-2] AS folder, '/out/' || x[-2] || '/' || x[-1] AS moved FROM p",
    "files_sorted": "SELECT page_id, url FROM pages ORDER BY url, page_id",
    "map_explode": "SELECT event_id, 'k' AS name, json_extract(props, '$.k')::BIGINT AS value FROM events",
    "json_field": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "json_repair": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[[' || props || '],' || chr(10) || '[' || props || ']' || chr(10) || ']' WHEN 1 THEN '[,[' || props || ']' || chr(10) || ']' ELSE '[]' END AS fixed FROM events""",
    "hex_decode": "SELECT p_partkey, p_name AS plain, p_name AS escaped FROM part",
    "mean_pool": "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1)::INT - 1 AS pos FROM embeddings) SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS mean FROM e GROUP BY 1, 2",
    "instruction_stats": "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS reads, count(*) FILTER (l_returnflag <> 'R') AS writes, count(DISTINCT l_partkey) AS sites FROM lineitem GROUP BY 1",
}

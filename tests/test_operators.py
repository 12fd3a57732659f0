"""Operators on small disassembler documents: sources, features, graphs, corpora, dedup, sinks."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gantry.functions import normalise, opcodes, paths, text
from gantry.operators import blocks, corpus, dedup, graphs, metadata, pool, tokeniser
from gantry.plans import commands
from gantry.sources import readers, sinks


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


DISASM = [
    ("and byte [rbx + 0x1f], ch", "and byte [rbx + IMM] ch", "and byte [reg64 + IMM] ch"),
    ("jne 0x4a1c", "jne MEM", "jne MEM"),
    ("mov eax, str.Some_text_here_", "mov eax STR", "mov reg32 STR"),
    ("movzx esi word [obj.A::B::c]", "movzx esi word DATA", "movzx reg32 word DATA"),
    ("cmp qword [reloc.stdout] 0", "cmp qword FUNC 0", "cmp qword FUNC 0"),
    ("jal method std::map<int, char>::~map()", "jal FUNC", "jal FUNC"),
    ("sw fp 0x1c0(sp)", "sw fp IMM(sp)", "sw fp IMM(sp)"),
    ("jal fcn.00401a30", "jal FUNC", "jal FUNC"),
    ("lw a1 -obj.__end__(gp)", "lw a1 DATA", "lw reg32 DATA"),
    ("ja case.0x5512.7", "ja MEM", "ja MEM"),
    ("ldr x9 [r3]", "ldr x9 [r3]", "ldr reg64 [reg32]"),
    ("stp x29 x30 [sp 0x70", "stp x29 x30 [sp 0x70", "stp fp reg64 [sp 0x70"),
    ("mov rax [rdi + rsi*4 + 0x888]", "mov rax [rdi + rsi*4 + IMM]", "mov reg64 [reg64 + reg64*4 + IMM]"),
    ("nop dword cs:[rax]", "nop", "nop"),
    ("and eax, 0xfffffff0", "and eax IMM", "and reg32 IMM"),
    ("call loc.imp.__stop", "call FUNC", "call FUNC"),
    ("ldr w1 aav.0x99887", "ldr w1 MEM", "ldr reg32 MEM"),
    ("mov rcx r8", "mov rcx r8", "mov reg64 reg32"),
]


def test_disasm_normalisation(spark):
    raw = [d for d, _, _ in DISASM]
    assert column(spark, raw, normalise.disasm) == [p for _, p, _ in DISASM]
    assert column(spark, raw, lambda c: normalise.disasm(c, True)) == [m for _, _, m in DISASM]
    assert column(spark, [None], normalise.disasm) == [None]


def test_esil_normalisation(spark):
    raw = ["0x18,rsp,-,[8],rbx,=", "0x51f3a0,rip,+,[8],rax,=", "edx,rdx,^,0xfffffff1,&", "4198400,rip,8,rsp", "77,r4,a7,s0"]
    call = lambda c: normalise.esil(c, F.lit("call"))
    other = lambda c: normalise.esil(c, F.lit("ucall"), True)
    assert column(spark, raw, call) == ["IMM,rsp,-,[8],rbx,=", "MEM,rip,+,[8],rax,=", "edx,rdx,^,IMM,&", "FUNC,rip,8,rsp", "77,r4,a7,s0"]
    assert column(spark, raw, other) == ["IMM rsp - [8] reg64 =", "MEM rip + [8] reg64 =", "reg32 reg64 ^ IMM &", "DATA rip 8 rsp", "77 reg32 reg32 reg32"]


def test_opcode_of_instruction(spark):
    rows = spark.createDataFrame([("invalid", "mov a"), ("nop", None), ("mov", "  mov eax, 1"), ("mov", ""), ("mov", None)], "k string, o string")
    assert [r[0] for r in rows.select(blocks.opcode(F.col("k"), F.col("o"))).collect()] == [None, "nop", "mov", None, None]


def test_arm_arithmetic_comes_from_a_rule():
    words = set(opcodes.arm_arithmetic())
    assert {"sub", "subeq", "subeqs", "adds", "umullnv", "ssatne16", "smlaltt", "qadd8al", "smla", "umul", "rsbmi", "smlabbeq"} <= words
    assert not {"mov", "bl", "cmp", "addmi", "rsbeq", "smlabb", "smlaltbcs"} & words
    assert len(words) > 1800


def test_repeat_prefixes_are_one_entry():
    assert {"rep movsq", "rep stosq", "rep"} <= set(opcodes.X86_GRP_COND_CTRANSFER) and not {"movsq", "stosq"} & set(opcodes.X86_GRP_COND_CTRANSFER)


def test_program_names(spark):
    lay = lambda p, k: column(spark, [p], lambda c: paths.program(c, k))[0]
    assert lay("/d/arm-gcc-9-O1_tool_cg-onehopcg/main.json", "cisco") == "tool"
    assert lay("/d/pkg-1.3_gcc-8_mips_64_O2_prog_cg-cg/main.json", "binkit") == lay("arm-32_pkg-2-O0_prog_cg-cg/x.json", "trex") == "prog"
    assert lay("x/lib-a.so.1-O3-0c4d_cg-cg/main.json", "binarycorp") == "lib-a.so.1"
    assert lay("main.json", "binkit") is None
    with pytest.raises(ValueError, match="layout"):
        paths.program(F.col("p"), "other")


def test_save_paths(spark):
    at = lambda p, *a: column(spark, [p], lambda c: paths.save_path(c, *a))[0]
    assert at("in/tool.json", "out/", ".json", "cg") == "out/tool-cg.json"
    assert at("in/x/tool.json", "a/out/") == "a/out/tool" and at("tool_cg.json", "out", "json", "gcg", "_cg") == "out/tool-gcg.json"
    assert column(spark, ["a" * 101, "b" * 100], paths.shortened) == ["a" * 75, "b" * 100]
    assert column(spark, ["f(a, \"b\"); ns::x'"], paths.stripped) == ["fa b nsx"]
    assert column(spark, ["a::b c-é.d"], paths.sanitised) == ["a__b_c-é.d"]


def test_tool_output(spark):
    assert column(spark, ["[]\n", '[{"a":1}]\n[{"a":2}]\n', '[]\n[{"a":1}]\n'], text.repaired_json)[0] == "[]"
    fixed = column(spark, ['[{"a":1}]\n[{"a":2}]'], text.repaired_json)[0]
    assert json.loads(fixed) == [[{"a": 1}], [{"a": 2}]]
    assert [bytes(x) for x in column(spark, ["\\x41\\x0az\\xzz", ""], text.escaped_bytes)] == [b"A\n", b""]
    lines = [["0x10  push ", " COPY a", "", "0x14 ret"]]
    assert column(spark, lines, text.assembly_lines, "array<string>") == [["0x10  push", "0x14 ret"]]
    assert column(spark, lines, text.pcode_lines, "array<string>") == [["COPY a", ""]]


# documents of a small program


def op(disasm, kind="mov", esil="0x10,rax,=", opcode=None):
    return {"type": kind, "disasm": disasm, "opcode": opcode or disasm, "esil": esil, "offset": 2**64 - 1, "refs": [{"addr": 5, "type": "CALL"}]}


def block(offset, jump=None, fail=None, ops=(), switch=None):
    return {"offset": offset, "ops": list(ops)} | ({"jump": jump} if jump is not None else {}) | ({"fail": fail} if fail is not None else {}) | ({"switchop": {"cases": switch}} if switch else {})


#: Nine blocks with the edges (0,2)(0,1)(1,3)(2,3)(3,5)(3,4)(4,8)(5,7)(5,6)(6,8)(7,8).
MAIN = [block(0, 2, 1), block(1, 3), block(2, 3), block(3, 5, 4), block(4, 8), block(5, 7, 6), block(6, 8), block(7, 8), block(8)]
EDGES = [(0, 2), (0, 1), (1, 3), (2, 3), (3, 5), (3, 4), (4, 8), (5, 7), (5, 6), (6, 8), (7, 8)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    main = [dict(b, ops=[op(f"mov eax, 0x{i}f"), op("call sym.imp.puts", "call", "4198400,rip,8,rsp"), op("add rax, rbx", "add")]) for i, b in enumerate(MAIN)]
    main[3]["switchop"] = {"cases": [{"jump": 5, "offset": 1, "value": 2**70}], "defval": 1}
    main[8]["jump"] = 2**70  # no 64-bit number: read as 0, which is a block's offset here
    small = [block(100, 101, ops=[op("ret", "ret")]), block(101)]
    (d / "tool_cfg.json").write_text(json.dumps([[{"name": "main", "blocks": main, "offset": 2**63, "unknown": 1}], [{"name": "small", "blocks": small}], [{"name": "bad", "blocks": [block(1, 2), block(2)] * 5}]]))
    (d / "broken_cfg.json").write_text("[[{]")
    (d / "tool_cg.json").write_text(json.dumps([{"name": "main", "size": 9, "imports": ["sym.a", "unk.0x1", "sym.b"]}, {"name": "sym.a", "size": 3, "imports": ["sym.b", "sym.c", "main"]}, {"name": "sym.b", "size": 1}, {"name": "alone", "size": 1, "imports": []}]))
    finfo = [{"name": n, "ninstrs": i * 3, "edges": i, "nbbs": i, "signature": f"{n} ()", "indegree": None if i else 4} for i, n in enumerate(["main", "sym.a", "sym.b"])]
    (d / "tool_finfo.json").write_text(json.dumps(finfo))
    (d / "tool_reg.json").write_text(json.dumps({"main": {"A": ["rax"], "R": ["rbx"], "@R": [2**64 - 1]}, "f": {"A": []}}))
    (d / "tool_pcode-func.json").write_text(json.dumps([{"function_name": "main", "pcode": {"pcode": ["COPY a", "ADD b", "RET"], "asm": ["0x1 mov"]}}]))
    blocks_ = [{"block_start_adr": 2**63 + a, "pcode": [f"P{a}", "Q"], "asm": [], "bb_info": {"addr": a, "jump": j and 2**63 + j, "fail": f and 2**63 + f}} for a, j, f in ((1, 3, 2), (2, 3, None), (3, None, None))]
    (d / "tool_pcode-bb.json").write_text(json.dumps([{"function_name": "main", "pcode_blocks": blocks_}, {"function_name": "one", "pcode_blocks": blocks_[:1]}]))
    return f"file://{d}"


@pytest.fixture(scope="module")
def functions(spark, folder):
    return readers.read(spark, folder, "cfg", recursive=True).cache()


def test_scan_of_functions(spark, folder, functions):
    rows = {r["name"]: r for r in functions.collect()}
    assert set(rows) == {"main", "small", "bad"} and rows["main"]["binary"] == "tool" and rows["main"]["func_idx"] == 0
    assert int(rows["main"]["offset"]) == 2**63 and int(rows["main"]["blocks"][0]["ops"][0]["offset"]) == 2**64 - 1
    assert [(b["jump"], b["fail"]) for b in rows["main"]["blocks"]][7:] == [(8, -1), (0, -1)]
    bad = readers.unreadable(readers.documents(spark, folder, "_cfg"), "cfg").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in bad] == ["broken_cfg.json"]


def test_other_scans(spark, folder):
    reg = {r["name"]: r["value"] for r in readers.read(spark, folder, "reg", recursive=True).collect()}
    assert reg["main"]["A"] == ["rax"] and int(reg["main"]["@R"][0]) == 2**64 - 1
    assert set(commands.extract(spark, folder, ["cg", "finfo"])) == {"cg", "finfo"}
    assert readers.listing(spark, folder.removeprefix("file://"), "_cg").count() == 1
    readers.validate("x/tool_cfg.json", "nlp")
    for path, command in (("tool_cg.json", "cfg"), ("tool_cfg.txt", "cfg"), ("tool.json", "cg"), ("tool_cg.json", "nothing")):
        with pytest.raises(ValueError):
            readers.validate(path, command)


def test_architecture_and_features(functions):
    rows = commands.with_arch(functions)
    assert {r["arch"] for r in rows.select("arch").collect()} == {"X86"}
    vectors = lambda k: F.transform("blocks", lambda b: blocks.features(b, F.col("arch"), k)).alias(k)
    got = rows.filter("name = 'main'").select(*map(vectors, blocks.FEATURES)).first()
    assert got["gemini"][0] == [1, 1, 1, 3, 1, 0, 2] and got["gemini"][3][6] == 3 and got["gemini"][8][6] == 1
    assert got["discovre"][0] == got["gemini"][0][:6]
    assert got["dgis"][0] == [0, 1, 0, 0, 1, 0, 0, 1] and all(sum(v) == 3 for v in got["dgis"])
    assert got["tiknib"][0] == [1, 0, 1, 1, 1, 0, 3]
    unknown = functions.select(F.transform("blocks", lambda b: blocks.gemini(b, F.lit(None)))[0].alias("v")).first()
    assert unknown["v"] is None


def test_function_statistics(functions):
    got = {r["name"]: r["features"] for r in metadata.tiknib_functions(commands.with_arch(functions)).collect()}
    assert got["main"]["avg_arithshift"] == got["main"]["avg_compare"] == 1 and got["main"]["sum_total"] == 27 and got["main"]["sum_compare"] == 0
    fixed = {r["name"]: r["features"] for r in metadata.tiknib_functions(commands.with_arch(functions), fixed=True).collect()}
    assert fixed["main"]["avg_compare"] == 0


def test_control_flow_graph(spark, functions):
    edges = functions.filter("name = 'main'").select(graphs.cfg_edges(F.col("blocks")).alias("e")).first()["e"]
    assert [(e["src"], e["dst"]) for e in edges] == [*EDGES, (8, 0)] and {e["weight"] for e in edges} == {1}
    got = {r["name"]: r["graph"] for r in commands.cfg_graphs(functions, "gemini").collect()}
    assert set(got) == {"main"}  # small has too few blocks, bad an invalid first offset
    assert [[a["id"] for a in n] for n in got["main"]["adjacency"]][:4] == [[1, 2], [3], [3], [4, 5]]
    assert [n["id"] for n in got["main"]["nodes"]] == list(range(9)) and got["main"]["nodes"][0]["numIns"] == 3
    texts = {r["name"]: r["graph"] for r in commands.cfg_graphs(functions, "disasm").collect()}
    assert texts["main"]["nodes"][2]["features"] == ["mov reg32 0x2f", "call FUNC", "add reg64 reg64"]
    labels = functions.filter("name = 'small'").select(graphs.address_labels(F.col("blocks")).alias("l")).first()["l"]
    assert labels == ["0x64 / 100", "0x65 / 101"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), max_size=2), min_size=1, max_size=12))
def test_walks_are_bounded_and_start_everywhere(successors):
    n = len(successors)
    successors = [[s for s in x if s < n] for x in successors]
    out = corpus.walks(successors)
    assert [w[0] for w in out] == list(range(n)) and all(1 <= len(w) <= 10 and len(set(w)) == len(w) for w in out)
    for walk in out:
        assert all(any(b in successors[a] for a in walk[:i]) for i, b in enumerate(walk) if i)


def test_walk_order_and_strict_counter():
    chain = [[i + 1] if i < 14 else [] for i in range(15)]
    assert corpus.walks([[2, 1], [3], [3], []])[0] == [0, 2, 3, 1]
    assert [len(w) for w in corpus.walks(chain)] == [10] * 6 + list(range(9, 0, -1))
    # the sixth walk ends by itself after ten hops, so the seventh has none left, and the next starts anew
    assert [len(w) for w in corpus.walks(chain, strict=True)] == [10] * 6 + [0, 8, 2, 6, 4, 4, 3, 2, 1]


def test_corpora(functions):
    strings = {r["name"]: r["text"] for r in commands.nlp(functions, "esil", "funcstring").collect()}
    assert set(strings) == {"main"} and strings["main"].startswith("IMM rax = FUNC rip 8 rsp IMM rax = IMM rax =")
    lines = commands.nlp(functions, "disasm", min_blocks=1).filter("name = 'main'").orderBy("ord").collect()
    assert len(lines) == 27 and lines[1]["text"] == "call FUNC"
    pairs = commands.nlp(functions, "disasm", pairs=True).orderBy("ord").collect()
    assert len([p for p in pairs if p["name"] == "main"]) == 26 and pairs[0]["text"].count("      ") == 1
    walk = commands.nlp(functions, "disasm", random_walk=True).filter("start = 0").orderBy("ord").collect()
    assert len(walk) == 27 and walk[3]["text"] == "mov eax 0x2f"
    assert commands.nlp(functions, "disasm", random_walk=True, pairs=True).filter("start = 0").count() == 26
    strict = commands.nlp(functions, "disasm", random_walk=True, strict=True)
    assert {r["name"] for r in strict.collect()} == {"main"} and commands.nlp(functions, "esil", random_walk=True).filter("text like 'IMM%'").count() > 0
    again = corpus.string_map(corpus.function_strings(functions, "esil").unionByName(corpus.function_strings(functions, "disasm").withColumn("func_idx", F.col("func_idx") + 9)))
    assert again.first()["strings"]["main"].startswith("mov eax")


def test_pcode(spark, folder):
    rows = readers.read(spark, folder, "pcode-func", recursive=True)
    assert [r["text"] for r in commands.nlp_pcode(rows, pairs=True).orderBy("ord").collect()] == ["COPY a ---- ADD b", "ADD b ---- RET"]
    assert commands.nlp_pcode(rows, form="funcstring").first()["text"] == "COPY a ADD b RET"
    bb = readers.read(spark, folder, "pcode-bb", recursive=True)
    assert commands.nlp_pcode(bb, True).filter("function_name = 'main'").orderBy("ord").first()["text"] == "P1\nQ"
    got = {r["function_name"]: r["graph"] for r in commands.pcode_graphs(bb).collect()}
    assert [[(a["id"], a["weight"]) for a in n] for n in got["main"]["adjacency"]] == [[(2, 1), (1, 0)], [(2, 1)], []]
    assert [int(n["start_addr"]) for n in got["main"]["nodes"]] == [2**63 + 1, 2**63 + 2, 2**63 + 3]
    assert len(got["one"]["nodes"]) == 1 and got["one"]["adjacency"] == [[]]
    with pytest.raises(ValueError):
        sinks.pcode_name("other", "func")


def _graph(rows, func):
    g = next(r["graph"] for r in rows if r["func"] == func)
    names = [n["funcName"] for n in g["nodes"]]
    return names, sorted((names[i], names[a["id"]]) for i, n in enumerate(g["adjacency"]) for a in n)


def test_call_graphs(spark, folder):
    entries = readers.read(spark, folder, "cg", recursive=True)
    assert _graph(commands.call_graphs(entries).collect(), "main") == (["main", "sym.a", "sym.b"], [("main", "sym.a"), ("main", "sym.b")])
    assert len(_graph(commands.call_graphs(entries, include_unk=True).collect(), "main")[0]) == 4
    hop = _graph(commands.call_graphs(entries, "onehopcg").collect(), "main")
    assert hop[0] == ["main", "sym.a", "sym.b", "sym.c"] and len(hop[1]) == 5
    callers = _graph(commands.call_graphs(entries, "cgcallers").collect(), "sym.b")
    assert callers == (["sym.b", "main", "sym.a"], [("main", "sym.b"), ("sym.a", "sym.b")])
    assert _graph(commands.call_graphs(entries, "onehopcgcallers").collect(), "alone") == (["alone"], [])
    some = graphs.local_edges(graphs.calls(entries), "onehopcgcallers", roots=spark.createDataFrame([("tool", "sym.a")], "binary string, func string"))
    assert {r["func"] for r in some.collect()} == {"sym.a"}


def test_strict_call_graphs(spark, folder):
    entries = readers.read(spark, folder, "cg", recursive=True)
    for variant in graphs.VARIANTS:  # without repeated names nothing differs but the place of nodes
        for func in ("sym.b", "alone"):
            plain, strict = (_graph(commands.call_graphs(entries, variant, strict=s).collect(), func) for s in (False, True))
            assert sorted(plain[0]) == sorted(strict[0]) and plain[1] == strict[1]
    rows = spark.createDataFrame([("p", 0, "f", ["g", "g", "f", "unk.1"]), ("p", 1, "g", ["f", "h", "h"]), ("p", 2, "unk.1", ["f"])], "binary string, func_idx int, name string, imports array<string>")
    got = commands.call_graphs(rows, "onehopcgcallers", strict=True).collect()
    g = next(r["graph"] for r in got if r["func"] == "f")
    assert [n["funcName"] for n in g["nodes"]] == ["f", "g", "g", "f", "f", "g", "unk.1", "h"]
    assert [[a["id"] for a in n] for n in g["adjacency"]] == [g_first(g), [7, 0], [], [], [0], [0], [], []]


def g_first(g):
    """The centre: its three imports, and, as its own callee's callee, edges to the first nodes of their names."""
    own = [a["id"] for a in g["adjacency"][0]]
    assert set(own) == {0, 1, 2, 3}
    return own


def test_node_metadata(spark, folder):
    entries, info = readers.read(spark, folder, "cg", recursive=True), readers.read(spark, folder, "finfo", recursive=True)
    rows = commands.call_graphs(entries, "cg", meta=commands.metadata_tables(info, "finfo"), kind="finfo").collect()
    nodes = {n["funcName"]: n["functionFeatureSubset"] for r in rows if r["func"] == "sym.a" for n in r["graph"]["nodes"]}
    assert nodes["main"]["indegree"] == 4 and nodes["sym.a"]["ninstrs"] == 3 and nodes["sym.a"]["signature"] == "sym.a ()"
    assert nodes["sym.c"]["name"] == "" and nodes["sym.c"]["ninstrs"] == 0
    extended = {r["name"]: r["avg_ins_bb"] for r in commands.metadata_tables(info, "finfo", True).collect()}
    assert str(extended["main"]) == "nan" and extended["sym.a"] == 3


def test_global_graph(spark, folder):
    entries = readers.read(spark, folder, "cg", recursive=True)
    rows, edges = commands.global_graphs(entries)
    got = {r["name"]: (r["id"], [a["id"] for a in r["adjacent"]]) for r in rows.collect()}
    assert got == {"main": (0, [2, 1]), "sym.a": (1, [0, 3, 2]), "sym.b": (2, []), "sym.c": (3, [])} and edges.count() == 5


def test_combination_by_place(spark, folder, functions):
    info = readers.read(spark, folder, "finfo", recursive=True)
    tiknib = metadata.tiknib_functions(commands.with_arch(functions))
    got = {r["name"]: r for r in commands.combos(info, tiknib).collect()}
    assert set(got) == {"main", "sym.a", "sym.b"} and got["sym.a"]["sum_total"] == 1 and "ninstrs" not in got["main"].asDict()
    assert [r["name"] for r in commands.combos(info, tiknib, by_name=True).collect()] == ["main"]
    with pytest.raises(ValueError):
        commands.combos(info, tiknib, "finfoe+tiknib")
    with pytest.raises(ValueError):
        metadata.zip_files(["a"], [])


def test_string_dedup(spark):
    rows = spark.createDataFrame([("p", "f", "x", 1), ("p", "f", "x", 2), ("p", "g", "x", 3), ("q", "f", "x", 4), ("p", "f", None, 5), ("p", "f", None, 6)], "binary string, name string, text string, path long")
    paths_of = lambda df: sorted(r["path"] for r in df.collect())
    assert paths_of(dedup.dedup_strings(rows)) == [1, 3, 4, 5]
    assert paths_of(dedup.dedup_strings(rows, value_only=True)) == [1, 4, 5]
    assert paths_of(dedup.dedup_strings(rows, value_only=True, strict=True)) == [1, 3, 4, 5]
    kept = dedup.dedup_strings(rows)
    assert paths_of(dedup.dedup_strings(kept)) == paths_of(kept) and paths_of(dedup.duplicates(rows, kept, ["path"])) == [2, 6]
    stats = {r["binary"]: (r["before"], r["after"], r["removed"], r["percent"]) for r in dedup.statistics(rows, ["binary"], ["name", "text"]).collect()}
    assert stats == {"p": (5, 3, 2, 40.0), "q": (1, 1, 0, 0.0)}
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_graph_files_and_dedup(spark, folder, tmp_path):
    entries = readers.read(spark, folder, "cg", recursive=True)
    for lay in ("a_tool_cg-cg", "b_tool_cg-cg", "c_other_cg-cg"):
        d = tmp_path / "graphs" / lay
        d.mkdir(parents=True)
        for r in commands.call_graphs(entries).select("func", F.to_json("graph").alias("g")).collect():
            (d / f"{r['func']}-cg.json").write_text(r["g"])
    (tmp_path / "graphs" / "a_tool_cg-cg" / "junk.json").write_text("{")
    kept = commands.dedup_graphs(spark, str(tmp_path / "graphs"), "cgname", "cisco")
    assert Counter(r["binary"] for r in kept.collect()) == {"tool": 4, "other": 4}
    gone = commands.dedup_graphs(spark, str(tmp_path / "graphs"), "cgname", "cisco", in_place=True)
    assert {r["path"].split("/")[-2] for r in gone.collect()} == {"b_tool_cg-cg"}
    sinks.write_graphs(commands.call_graphs(entries), f"file://{tmp_path}/out", "cg", by="binary")
    back = spark.read.json(f"file://{tmp_path}/out")
    assert {r["file"] for r in back.collect()} == {"main-cg.json", "sym.a-cg.json", "sym.b-cg.json", "alone-cg.json"}


def test_string_files(spark, tmp_path):
    (tmp_path / "x86_tool-efs.json").write_text(json.dumps({"f": "a", "g": "a"}))
    (tmp_path / "arm_tool-efs.json").write_text(json.dumps({"f": "a"}))
    (tmp_path / "arm_none-efs.json").write_text("{}")
    kept = commands.dedup_strings(spark, str(tmp_path))
    assert {(r["binary"], r["arch"], r["name"]) for r in kept.collect()} == {("tool-efs.json", "arm", "f"), ("tool-efs.json", "x86", "g")}
    assert commands.dedup_strings(spark, str(tmp_path), value_only=True, only_statistics=True).first()["removed"] == 2


def test_lines_and_bytes(spark, functions, tmp_path):
    sinks.write_lines(commands.nlp(functions, min_blocks=1), f"file://{tmp_path}/lines")
    assert spark.read.text(f"file://{tmp_path}/lines").count() > 27
    rows = spark.createDataFrame([("t", 0, "a::b", "4142"), ("t", 1, "a  b", "43"), ("t", 2, "a__b", "44")], "binary string, func_idx int, name string, bytes string")
    sinks.write_bytes(rows, f"file://{tmp_path}/bytes")
    assert {(r["file"], bytes(r["bytes"])) for r in spark.read.parquet(f"file://{tmp_path}/bytes").collect()} == {("a__b.bin", b"AB")}
    assert sinks.new_only(rows, rows.limit(0), ["name"]).count() == 3


def test_stream_of_files(spark, folder, tmp_path):
    from gantry.streaming import incremental

    rows = incremental.first_seen(incremental.stream_documents(spark, folder, "cg").select("binary", "name", "size"), ["binary"], ["name"])
    incremental.write_stream(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    incremental.write_stream(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_mean_pool(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0])], "k int, v array<float>")
    assert {r["k"]: r["embedding"] for r in pool.pooled(rows, ["k"], "v").collect()} == {1: [2.0, 3.0], 2: [5.0]}


def test_tokeniser(spark, tmp_path):
    rows = spark.createDataFrame([("  low low lower 12  ",), ("lowest new",), (None,), ("",)], "text string")
    counts = {r["token"]: r["n"] for r in tokeniser.pretoken_counts(rows).collect()}
    assert counts == {" low": 2, " lower": 1, " 12": 1, " lowest": 1, " new": 1}
    vocabulary, merges = tokeniser.learn(rows, 24)
    assert list(vocabulary)[:5] == ["<s>", "<pad>", "</s>", "<unk>", "<mask>"] and len(vocabulary) == 24
    assert "Ġlow" in vocabulary and merges[0] in (("l", "o"), ("o", "w"), ("Ġ", "l"))
    commands.train_tokeniser(rows, str(tmp_path / "t.json"), 24)
    assert json.loads((tmp_path / "t.json").read_text())["model"]["vocab"] == vocabulary
    with pytest.raises(ValueError):
        tokeniser.learn(rows, kind="comma-bpe")


def test_tokeniser_refuses_part_of_the_pretokens(spark):
    rows = spark.createDataFrame([("low low low",), ("new é",)], "text string")
    vocabulary, _ = tokeniser.learn(rows, 24, max_words=3)
    assert {tokeniser.byte_alphabet()[b] for b in " lownewé".encode()} <= set(vocabulary)
    with pytest.raises(ValueError):
        tokeniser.learn(rows, 24, max_words=2)


def test_plans_stay_in_the_jvm(functions):
    for df in (commands.cfg_graphs(functions, "tiknib"), commands.nlp(functions, "esil", "funcstring", registers=True), metadata.tiknib_functions(commands.with_arch(functions))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_attributed_cfg_computes_blocks_once(spark):
    """The mnemonic of an operation is found once in the plan, and no filter repeats what the projection computes."""
    from gantry.plans.functions import _functions
    from tests.compare import DATA

    plan = graphs.attributed_cfg(_functions(spark, f"{DATA}/sf0.001"), "gemini", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and "Filter" not in plan


def test_local_edges_once_each(spark):
    """Every edge once, with the least rank, without grouping the edges: calls to itself, back, and from and to unknown functions."""
    from itertools import product

    names = ["a", "b", "c", "unk.d"]
    calls = [("p", i, x, j, y) for (i, x), (j, y) in product(enumerate(names), enumerate(names)) if (i * 7 + j * 5) % 3]
    called = spark.createDataFrame(calls, "binary string, func_idx int, caller string, ord int, callee string")
    roots = spark.createDataFrame([("p", "a"), ("p", "unk.d")], "binary string, func string")
    got, want = [], []
    for variant, unk, some in product(graphs.VARIANTS, (True, False), (None, ["a", "unk.d"])):
        steps = graphs.VARIANTS[variant]
        every = [(x, x, y, [1, j, j]) for _, _, x, j, y in calls]
        every += [(y, x, y, [2, i, j]) for _, i, x, j, y in calls if "callers" in steps and (unk or not x.startswith("unk."))]
        every += [(x, y, z, [3, j, k]) for _, _, x, j, y in calls for _, _, m, k, z in calls if "hop" in steps and m == y]
        least: dict = {}
        for f, x, y, r in every:
            if some is None or f in some:
                least[f, x, y] = min(r, least.get((f, x, y), r))
        case = f"{variant} {unk} {some}"
        want += [(case, *k, r) for k, r in least.items()]
        edges = graphs.local_edges(called, variant, unk, None if some is None else roots)
        got.append(edges.selectExpr(f"'{case.replace(chr(39), chr(34))}' AS c", "func", "src", "dst", "rank"))
    from functools import reduce

    rows = reduce(lambda a, b: a.union(b), got).coalesce(1).collect()
    assert sorted((r["c"].replace('"', "'"), r["func"], r["src"], r["dst"], r["rank"]) for r in rows) == sorted(want)
    plan = graphs.local_edges(called, "cgcallers")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" not in plan


def test_graph_documents_without_a_join(spark):
    """One exchange deals nodes and edges to their graph; nodes without edges and edges without nodes of their graph."""
    nodes = spark.createDataFrame([("p", "f", "f", [0, 0, 0]), ("p", "f", "g", [1, 0, 0]), ("p", "x", "x", [0, 0, 0])], "binary string, func string, name string, rank array<int>")
    edges = spark.createDataFrame([("p", "f", "f", "g", [1, 0, 0]), ("p", "f", "g", "f", [2, 0, 0]), ("p", "none", "a", "b", [1, 0, 0])], "binary string, func string, src string, dst string, rank array<int>")
    out = graphs.graph_documents(nodes, edges)
    got = {r["func"]: ([n["funcName"] for n in r["graph"]["nodes"]], [[a["id"] for a in x] for x in r["graph"]["adjacency"]]) for r in out.collect()}
    assert got == {"f": (["f", "g"], [[1], [0]]), "x": (["x"], [[]])}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once(spark):
    """Once as they are and once repaired; the plan names neither a second time."""
    files = spark.createDataFrame([("/in/a_cfg.json", "[]"), ("/in/b_cfg.json", None), ("/in/c_cfg.json", "{")], "path string, document string")
    rows = readers.parse(files, "cfg")
    assert rows.count() == 0
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2

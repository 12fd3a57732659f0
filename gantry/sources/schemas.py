"""Schemas of the disassembler's JSON files and of the documents made from them.

Unknown fields are ignored. Addresses that need their high half are decimals. Two fields
are read as text because a missing and an oversized value mean different things: a
block's `jump` is -1 where it is missing and 0 where it is no 64-bit number.
"""

from __future__ import annotations

ADDRESS, WIDE = "decimal(20,0)", "decimal(38,0)"

# Field names and types of the input files.
OP = f"""struct<bytes:string, comment:string, disasm:string, esil:string, family:string, fcn_addr:{ADDRESS}, fcn_last:{ADDRESS},
  flags:array<string>, offset:{ADDRESS}, opcode:string, ptr:{WIDE}, refptr:{WIDE}, refs:array<map<string,string>>, reloc:boolean,
  size:bigint, type:string, type2_num:bigint, type_num:bigint, xrefs:array<map<string,string>>, val:{ADDRESS}>"""
SWITCH = f"struct<cases:array<struct<jump:bigint, offset:bigint, value:string>>, defval:int, maxval:int, minval:int, offset:{ADDRESS}>"
BLOCK = f"struct<offset:bigint, jump:string, fail:bigint, size:bigint, switchop:{SWITCH}, ops:array<{OP}>>"
FUNCTION = f"struct<name:string, nargs:bigint, ninstr:bigint, nlocals:bigint, offset:{ADDRESS}, size:{ADDRESS}, stack:bigint, type:string, blocks:array<{BLOCK}>>"
CFG = f"array<array<{FUNCTION}>>"
CALL = "struct<name:string, size:bigint, imports:array<string>>"
INFO = f"""struct<offset:{ADDRESS}, name:string, size:{WIDE}, `is-pure`:string, realsz:bigint, noreturn:boolean, stackframe:bigint, calltype:string,
  cost:bigint, cc:bigint, bits:bigint, type:string, nbbs:bigint, `is-lineal`:boolean, ninstrs:bigint, edges:bigint, ebbs:bigint, signature:string,
  minbound:{ADDRESS}, maxbound:{WIDE}, callrefs:array<struct<addr:string, type:string, at:bigint>>, datarefs:array<string>,
  codexrefs:array<struct<addr:bigint, type:string, at:bigint>>, dataxrefs:array<bigint>, indegree:bigint, outdegree:bigint, nlocals:bigint,
  nargs:bigint, bpvars:array<struct<name:string, kind:string, type:string, ref:struct<base:string, offset:bigint>>>, spvars:array<string>,
  regvars:array<struct<name:string, kind:string, type:string, ref:string>>, difftype:string>"""
AVERAGES = ", ".join(f"{a}_{n}:float" for a in ("avg", "sum") for n in ("arithshift", "compare", "ctransfer", "ctransfercond", "dtransfer", "float", "total"))
TIKNIB = f"struct<name:string, features:struct<{AVERAGES}>>"
COMBO = f"struct<name:string, edges:bigint, indegree:bigint, outdegree:bigint, nlocals:bigint, nargs:bigint, {AVERAGES}>"
REGISTERS = f"map<string, struct<A:array<string>, I:array<string>, R:array<string>, W:array<string>, V:array<string>, N:array<string>, `@R`:array<{ADDRESS}>, `@W`:array<{ADDRESS}>>>"
XREFS = f"map<string, array<struct<type:string, at:bigint, ref:{WIDE}, name:string>>>"
LOCAL_XREFS = "map<string, struct<reads:array<struct<name:string, addrs:array<bigint>>>, writes:array<struct<name:string, addrs:array<bigint>>>>>"
DECOMPILED = "map<string, struct<code:string, annotations:array<struct<start:bigint, end:bigint, type:string, syntax_highlight:string, name:string, offset:bigint>>>>"
VARIABLES = "map<string, struct<reg:array<struct<name:string, kind:string, type:string, ref:string>>, sp:array<string>, bp:array<struct<name:string, kind:string, type:string, ref:struct<base:string, offset:bigint>>>>>"
PCODE = "struct<function_name:string, pcode:struct<pcode:array<string>, asm:array<string>>>"
BLOCK_INFO = f"struct<addr:{ADDRESS}, size:bigint, jump:{ADDRESS}, fail:{ADDRESS}, opaddr:{ADDRESS}, inputs:bigint, outputs:bigint, ninstr:bigint, instrs:array<{ADDRESS}>, traced:boolean>"
PCODE_BLOCKS = f"struct<function_name:string, pcode_blocks:array<struct<block_start_adr:{ADDRESS}, pcode:array<string>, asm:array<string>, bb_info:{BLOCK_INFO}>>>"
STRINGS = "struct<vaddr:bigint, paddr:bigint, ordinal:bigint, size:bigint, length:bigint, section:string, type:string, string:string>"
ZIGNATURES = """struct<name:string, bytes:string, mask:string, graph:struct<cc:bigint, nbbs:bigint, edges:bigint, ebbs:bigint, bbsum:bigint>, addr:bigint, next:string,
  types:string, refs:array<string>, xrefs:array<string>, collisions:array<string>, vars:array<struct<name:string, type:string, kind:string, delta:bigint, isarg:boolean>>, hash:struct<bbhash:string>>"""
FUNCTION_STRINGS = "map<string, string>"
ADJACENCY = "array<array<struct<id:bigint, weight:bigint>>>"


def graph(node: str) -> str:
    """Schema of a graph document with nodes of a type."""
    return f"struct<adjacency:{ADJACENCY}, directed:string, graph:array<string>, multigraph:boolean, nodes:array<{node}>>"


SUBSET_NODE = "struct<name:string, ninstrs:bigint, edges:bigint, indegree:bigint, outdegree:bigint, nlocals:bigint, nargs:bigint, signature:string>"
NODES = {
    "cgname": "struct<id:bigint, funcName:string>",
    "cgmeta": f"struct<id:bigint, funcName:string, functionFeatureSubset:{SUBSET_NODE}>",
    "tiknib": f"struct<id:bigint, funcName:string, features:{TIKNIB}>",
}

#: Extracted documents by mode: schema, and whether it is an array of rows or a map by function.
MODES = {
    "cfg": (CFG, "functions"),
    "cg": (f"array<{CALL}>", "rows"),
    "finfo": (f"array<{INFO}>", "rows"),
    "reg": (REGISTERS, "map"),
    "func-xrefs": (XREFS, "map"),
    "localvar-xrefs": (LOCAL_XREFS, "map"),
    "decomp": (DECOMPILED, "map"),
    "fvars": (VARIABLES, "map"),
    "pcode-func": (f"array<{PCODE}>", "rows"),
    "pcode-bb": (f"array<{PCODE_BLOCKS}>", "rows"),
    "strings": (f"array<{STRINGS}>", "rows"),
    "zigs": (f"array<{ZIGNATURES}>", "rows"),
    "tiknib": (f"array<{TIKNIB}>", "rows"),
    "finfo-tiknib": (f"array<{COMBO}>", "rows"),
    "efs": (FUNCTION_STRINGS, "map"),
    "dfs": (FUNCTION_STRINGS, "map"),
}

#: Fields without which a file counts as unreadable.
REQUIRED = {"cfg": ("name", "blocks"), "cg": ("name",), "finfo": ("name", "ninstrs", "edges", "nbbs", "signature"), "pcode-func": ("function_name",), "pcode-bb": ("function_name", "pcode_blocks"), "tiknib": ("name", "features"), "finfo-tiknib": ("name",)}

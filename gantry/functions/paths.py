"""Names and paths as column expressions: program names, save paths, file-name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names of plain and finfo call graphs lose.
STRIPPED = "(),\";:'"


def parent(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def program_cisco(path: Column) -> Column:
    return F.get(F.split(parent(path), "_"), F.lit(1))


def program_binkit(path: Column) -> Column:
    """Also for trex paths."""
    return F.try_element_at(F.split(parent(path), "_"), F.lit(-2))


def program_binarycorp(path: Column) -> Column:
    return F.substring_index(parent(path), "-O", 1)


PROGRAM = {"cisco": program_cisco, "binkit": program_binkit, "trex": program_binkit, "binarycorp": program_binarycorp}


def program(path: Column, layout: str) -> Column:
    """Program of a graph file's path, by the data set's layout."""
    if layout not in PROGRAM:
        raise ValueError(f"unknown path layout {layout!r}: one of {', '.join(PROGRAM)}")
    return PROGRAM[layout](path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a name that starts with its only dot keeps it."""
    return F.regexp_replace(file_name(path), F.lit(r"(?<=.)\.[^.]*$"), F.lit(""))


def string_file_parts(name: Column) -> tuple[Column, Column]:
    """(program, architecture) of a function-string file's name: its last and first part."""
    parts = F.split(name, "_")
    return F.element_at(parts, -1), F.get(parts, F.lit(0))


def save_path(path: Column, folder: str, extension: str | None = None, suffix: str | None = None, remove: str | None = None) -> Column:
    """`folder/stem[-suffix][.extension]`, with a substring of the stem removed if asked for."""
    name = F.replace(stem(path), F.lit(remove), F.lit("")) if remove else stem(path)
    end = "" if extension is None else extension if extension.startswith(".") else f".{extension}"
    return F.concat(F.lit(folder.removesuffix("/") + "/"), name, F.lit((f"-{suffix}" if suffix is not None else "") + end))


def sanitised(name: Column) -> Column:
    """Everything but word characters, dots and minus signs becomes an underscore."""
    return F.regexp_replace(name, F.lit(r"(?U)[^\w.-]"), F.lit("_"))


def shortened(name: Column) -> Column:
    """Names of more than 100 characters are cut to their first 75."""
    return F.when(F.length(name) > 100, F.substring(name, 1, 75)).otherwise(name)


def stripped(name: Column) -> Column:
    return F.translate(name, STRIPPED, "")


def last_two(path: Column, folder: str) -> Column:
    """The last two parts of a path under another folder."""
    return F.concat(F.lit(folder.removesuffix("/") + "/"), F.array_join(F.slice(F.split(path, "/"), -2, 2), "/"))


def without_graph_suffix(name: Column) -> Column:
    """The part before the first `.j`."""
    return F.substring_index(name, ".j", 1)

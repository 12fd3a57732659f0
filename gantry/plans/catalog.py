"""All queries of the engine's own operators on the relational tables, and the SQL that states the same.

The tables hold no binaries, so conversations stand in for functions and blocks, order
lines for instructions and calls, documents for function strings, parts for metadata.
Every query covers its whole tables.
"""

from __future__ import annotations

from gantry.plans import calls, functions, rows, texts


def _program(query):
    """Results call the program so: the operators' own name for it is a keyword in some SQL dialects."""
    return lambda spark, d: query(spark, d).withColumnRenamed("binary", "program")


QUERIES: dict = {n: _program(q) for n, q in {**rows.QUERIES, **texts.QUERIES, **calls.QUERIES, **functions.QUERIES}.items()}
ORACLE_SQL: dict = {**rows.ORACLE_SQL, **texts.ORACLE_SQL, **calls.ORACLE_SQL, **functions.ORACLE_SQL}

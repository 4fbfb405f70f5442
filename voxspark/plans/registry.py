"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxspark.sources import bindings

#: Columns that count rows; both engines give them as 64-bit integers.
LONGS = {"segment_index", "cluster_id", "seg_id", "pos", "part", "frame", "d", "chunk_index", "n_words"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the bound tables; names of bound tables in the SQL get their definitions put in front."""

    def add(f: Callable[[bindings.Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(bindings.Tables(spark, sf_dir))
            return out.withColumns({c: out[c].cast("long") for c, kind in out.dtypes if kind == "int" and c in LONGS})

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_bindings(sql)
        return f

    return add


def with_bindings(sql: str) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for name, definition in bindings.SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(definition)
                needed.append(name)

    need(sql)
    own = sql.strip()
    recursive = "RECURSIVE " if own.upper().startswith("WITH RECURSIVE") else ""
    head = ", ".join(f"{n} AS MATERIALIZED ({bindings.SQL[n].strip()})" for n in needed)
    if not head:
        return own
    own = re.sub(r"^WITH (RECURSIVE )?", ", ", own, flags=re.IGNORECASE) if own.upper().startswith("WITH") else f" {own}"
    return f"WITH {recursive}{head}{own}"

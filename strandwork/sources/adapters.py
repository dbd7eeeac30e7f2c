"""Repository adapters: callables that yield the standard table set, and what is refused or reported of their answer."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# The standard tables: key, columns, and whether every adapter must give the table.
TABLES = {
    "repositories": ("repo_key", "repo_key string, root_scope string", True),
    "assets": ("asset_id", "asset_id string, repo_key string, path string, digest string", True),
    "declarations": ("ref", "ref bigint, repo_key string, scope_id string, name string, kind string", True),
    "scopes": ("scope_id", "scope_id string, repo_key string, kind string, name string, parent string", True),
    "units": ("unit_id", "unit_id string, representative bigint, members array<bigint>", True),
    "coverage": ("ref", "ref bigint, part string, status string", False),
    "source_texts": ("ref", "ref bigint, text_kind string, locale string, text string", False),
}
# Tables of which several rows may share the key column.
REPEATING = ("coverage", "source_texts")
# (table, column, named table, code); a missing value in the column names nothing.
LINKS = (
    ("assets", "repo_key", "repositories", "unknown_repository"),
    ("declarations", "repo_key", "repositories", "unknown_repository"),
    ("declarations", "scope_id", "scopes", "unknown_scope"),
    ("repositories", "root_scope", "scopes", "unknown_scope"),
    ("scopes", "repo_key", "repositories", "unknown_repository"),
    ("scopes", "parent", "scopes", "unknown_parent"),
    ("units", "representative", "declarations", "unknown_declaration"),
    ("coverage", "ref", "declarations", "unknown_declaration"),
    ("source_texts", "ref", "declarations", "unknown_declaration"),
)


@dataclass(frozen=True)
class Context:
    """What an adapter is given: the session, where the repository lies, and at which revision."""

    spark: SparkSession
    path: str
    revision: str | None = None


class Adapter(Protocol):
    def collect(self, context: Context) -> dict[str, DataFrame]: ...


class AdapterError(ValueError):
    """An adapter's answer does not have the shape of the standard table set."""


def collected(adapter: Adapter, context: Context) -> dict[str, DataFrame]:
    """The adapter's tables in the standard columns and their order.

    Refused before any job runs: unknown tables, missing required ones, unknown, missing or repeated columns, and
    columns of another type.  Optional tables that the adapter leaves out come back empty.
    """
    given = adapter.collect(context)
    faults = [f"unknown table {t}" for t in sorted(given.keys() - TABLES.keys())]
    out = {}
    for table, (_, ddl, required) in TABLES.items():
        want = {f.name: f.dataType for f in StructType.fromDDL(ddl)}
        if table not in given:
            if required:
                faults.append(f"missing table {table}")
            out[table] = context.spark.createDataFrame([], ddl)
            continue
        schema = given[table].schema
        have = {f.name: f.dataType for f in schema}
        wrong = [f"repeated column {table}.{c}" for c in sorted(have) if schema.names.count(c) > 1]
        wrong += [f"unknown column {table}.{c}" for c in sorted(have.keys() - want.keys())]
        wrong += [f"missing column {table}.{c}" for c in want if c not in have]
        wrong += [f"{table}.{c} is {have[c].simpleString()}, not {t.simpleString()}" for c, t in want.items()
                  if c in have and have[c].simpleString() != t.simpleString()]
        faults += wrong
        if not wrong:
            out[table] = given[table].select(*want)
    if faults:
        raise AdapterError("; ".join(faults))
    return out


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of the collected tables that contradict each other: (table, code, key, value), each once.

    A row without a key, a key of several rows, a value that names no row of the other table, and members of a unit
    that are no declarations.
    """
    text = lambda c: F.col(c).cast("string")
    row = lambda df, table, code, key, value: df.select(
        F.lit(table).alias("table"), F.lit(code).alias("code"), key.alias("key"), value.alias("value"))
    none: Column = F.lit(None).cast("string")
    found = []
    for table, (key, _, _) in TABLES.items():
        found.append(row(tables[table].where(F.col(key).isNull()), table, "missing_key", none, none))
        if table not in REPEATING:
            several = tables[table].where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
            found.append(row(several, table, "repeated_key", text(key), text("n")))
    known = {t: tables[t].select(F.col(TABLES[t][0]).alias("named")).where("named IS NOT NULL").distinct() for t in TABLES}
    members = tables["units"].select("unit_id", F.explode("members").alias("member"))
    asked = [(t, tables[t], c, of, code) for t, c, of, code in LINKS] + [("units", members, "member", "declarations", "unknown_member")]
    for table, df, column, of, code in asked:
        lost = df.where(F.col(column).isNotNull()).join(known[of], F.col(column) == F.col("named"), "left_anti")
        found.append(row(lost, table, code, text(TABLES[table][0]), text(column)))
    return functools.reduce(DataFrame.unionAll, found).distinct()

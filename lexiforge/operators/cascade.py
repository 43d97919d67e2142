"""Deletes that follow declared foreign keys: cascade, set null or restrict, with counts of what they touch.

The keys are edges of a graph of tables.  Where the edges that cascade from the first table have no
cycle, the tables are walked in topological order, one semi join an edge.  Where they have one, also that
of a table with itself, the newly deleted keys of each round look for the rows that name them until a
round finds none; every round writes its keys, so plans stay short.  What is left of a table is
what no edge takes, so rows without a key of their own are found as well.  A null reference names nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import written


class RestrictedDelete(Exception):
    """Rows that may not lose what they name stand against the delete."""


@dataclass(frozen=True)
class ForeignKey:
    """child.column names parent's key; on_delete is cascade, set_null or restrict."""

    child: str
    column: str
    parent: str
    on_delete: str = "cascade"


@dataclass
class Deleted:
    """The tables afterwards, and per table and column what happened to how many rows."""

    tables: dict[str, DataFrame]
    impact: DataFrame


def _reached(root: str, edges: Sequence[ForeignKey]) -> list[ForeignKey]:
    """The cascading edges that a delete in root can come along."""
    seen, found = {root}, True
    while found:
        found = False
        for e in edges:
            if e.parent in seen and e.child not in seen:
                seen.add(e.child)
                found = True
    return [e for e in edges if e.parent in seen]


def _order(root: str, edges: Sequence[ForeignKey]) -> list[str] | None:
    """The tables in topological order; None if there is a cycle."""
    tables = {root, *(e.child for e in edges)}
    waiting = {t: {e.parent for e in edges if e.child == t} for t in tables}
    out: list[str] = []
    while waiting:
        free = sorted(t for t, parents in waiting.items() if parents <= set(out))
        if not free:
            return None
        out += free
        for t in free:
            del waiting[t]
    return out


def _naming(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return df.join(keys, df[column] == keys["_key"], "left_semi")


def _not_naming(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return df.join(keys, df[column] == keys["_key"], "left_anti")


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()


def _gone_in_order(tables: Mapping[str, DataFrame], keys: Mapping[str, str], root: str, victims: DataFrame, edges: Sequence[ForeignKey], order: list[str]) -> dict[str, DataFrame]:
    gone = {root: victims}
    for table in order:
        found = [_keys(_naming(tables[table], e.column, gone[e.parent]), keys[table]) for e in edges if e.child == table]
        # A table that no edge leaves needs no keys of its own.
        if found and any(e.parent == table for e in edges):
            every = reduce(DataFrame.unionByName, found + ([gone[table]] if table in gone else [])).distinct()
            gone[table] = written(every, "deleted-keys")
    return gone


def _gone_by_rounds(tables: Mapping[str, DataFrame], keys: Mapping[str, str], root: str, victims: DataFrame, edges: Sequence[ForeignKey]) -> dict[str, DataFrame]:
    gone, fresh = {root: victims}, {root: victims}
    while fresh:
        found: dict[str, list[DataFrame]] = {}
        for e in edges:
            if e.parent in fresh:
                found.setdefault(e.child, []).append(_keys(_naming(tables[e.child], e.column, fresh[e.parent]), keys[e.child]))
        fresh = {}
        for table, parts in found.items():
            new = reduce(DataFrame.unionByName, parts).distinct()
            new = written(new.join(gone[table], "_key", "left_anti") if table in gone else new, "deleted-keys")
            if not new.isEmpty():
                fresh[table] = new
                gone[table] = written(gone[table].unionByName(new), "deleted-keys") if table in gone else new
    return gone


def delete(tables: Mapping[str, DataFrame], keys: Mapping[str, str], root: str, victims: DataFrame, foreign_keys: Sequence[ForeignKey]) -> Deleted:
    """Deletes from root the rows whose key is in victims (one column), and follows the foreign keys.

    tables and keys (of each table the column that is its key) by name.  Raises RestrictedDelete, and
    changes nothing, if a row that stays names a deleted one by a restricting key."""
    cascading = _reached(root, [e for e in foreign_keys if e.on_delete == "cascade"])
    asked = victims.select(victims[victims.columns[0]].alias("_key")).where("_key is not null").distinct()
    asked = written(asked, "deleted-keys")
    order = _order(root, cascading)
    gone = _gone_by_rounds(tables, keys, root, asked, cascading) if order is None else _gone_in_order(tables, keys, root, asked, cascading, order)
    left: dict[str, DataFrame] = dict(tables)
    left[root] = _not_naming(left[root], keys[root], gone[root])
    for e in cascading:
        if e.parent in gone:
            left[e.child] = _not_naming(left[e.child], e.column, gone[e.parent])
    counts = []
    for table in {root, *(e.child for e in cascading)}:
        sizes = tables[table].select(F.lit(1).alias("n"), F.lit(0).alias("kept")).unionByName(left[table].select(F.lit(0).alias("n"), F.lit(1).alias("kept")))
        counts.append(sizes.agg(F.lit(table).alias("table"), F.lit("deleted").alias("action"), F.lit(keys[table]).alias("column"), F.coalesce(F.sum("n") - F.sum("kept"), F.lit(0)).alias("rows")))
    for e in foreign_keys:
        if e.on_delete == "cascade" or e.parent not in gone:
            continue
        hit = _naming(left[e.child], e.column, gone[e.parent])
        if e.on_delete == "restrict":
            if not hit.isEmpty():
                raise RestrictedDelete(f"{e.child}.{e.column} names rows of {e.parent}")
            continue
        counts.append(hit.agg(F.lit(e.child).alias("table"), F.lit("set_null").alias("action"), F.lit(e.column).alias("column"), F.count(F.lit(1)).alias("rows")))
        named = gone[e.parent].select(F.col("_key").alias("_named"), F.lit(True).alias("_hit"))
        joined = left[e.child].join(named, F.col(e.column) == F.col("_named"), "left")
        left[e.child] = joined.withColumn(e.column, F.when(F.col("_hit").isNull(), F.col(e.column))).drop("_named", "_hit")
    return Deleted(left, reduce(DataFrame.unionByName, counts))

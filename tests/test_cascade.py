"""Deletes along foreign keys against a plain fixed point."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators.cascade import ForeignKey, RestrictedDelete, delete


def plainly(tables, keys, root, victims, edges):
    """tables {name: [dict]} to (tables, impact)."""
    gone = {t: set() for t in tables}
    doomed = {t: [False] * len(rows) for t, rows in tables.items()}
    for k, row in enumerate(tables[root]):
        if row[keys[root]] in victims:
            doomed[root][k] = True
    gone[root] = set(victims)
    changed = True
    while changed:
        changed = False
        for e in edges:
            if e.on_delete != "cascade":
                continue
            for k, row in enumerate(tables[e.child]):
                if not doomed[e.child][k] and row[e.column] is not None and row[e.column] in gone[e.parent]:
                    doomed[e.child][k] = changed = True
                    gone[e.child].add(row[keys[e.child]])
        for t in tables:
            for k, row in enumerate(tables[t]):
                if row[keys[t]] is not None and row[keys[t]] in gone[t] and not doomed[t][k] and t == root:
                    doomed[t][k] = changed = True
    left = {t: [dict(r) for k, r in enumerate(rows) if not doomed[t][k]] for t, rows in tables.items()}
    nulled = {}
    for e in edges:
        if e.on_delete == "set_null":
            hit = [r for r in left[e.child] if r[e.column] is not None and r[e.column] in gone[e.parent]]
            nulled[e.child, e.column] = len(hit)
            for r in hit:
                r[e.column] = None
    return left, {t: sum(d) for t, d in doomed.items()}, nulled


def frames(spark, tables):
    return {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} long" for c in rows[0])) for t, rows in tables.items()}


@pytest.mark.parametrize("cyclic", [False, True])
def test_deletes_equal_a_plain_fixed_point(spark, cyclic):
    rnd = random.Random(cyclic)
    pick = lambda n: rnd.choice([None, *range(n)])
    tables = {
        "a": [{"id": k, "boss": pick(30) if cyclic else None, "c": pick(40) if cyclic else None} for k in range(30)],
        "b": [{"id": k, "a": pick(30), "other": pick(30)} for k in range(60)] + [{"id": None, "a": 1, "other": None}],
        "c": [{"id": k, "b": pick(60), "a": pick(30)} for k in range(90)],
        "d": [{"id": k, "b": pick(60), "c": pick(90)} for k in range(90)],
    }
    keys = dict.fromkeys(tables, "id")
    edges = [ForeignKey("b", "a", "a"), ForeignKey("b", "other", "a", "set_null"), ForeignKey("c", "b", "b"), ForeignKey("c", "a", "a", "set_null"), ForeignKey("d", "c", "c"), ForeignKey("d", "b", "b", "set_null")]
    edges += [ForeignKey("a", "boss", "a"), ForeignKey("a", "c", "c")] if cyclic else []
    victims = {1, 4, 7}
    got = delete(frames(spark, tables), keys, "a", spark.createDataFrame([(v,) for v in [*victims, 4, None]], "id long"), edges)
    left, deleted, nulled = plainly(tables, keys, "a", victims, edges)
    for t, rows in left.items():
        assert sorted(map(str, (tuple(r.values()) for r in rows))) == sorted(map(str, (tuple(r) for r in got.tables[t].collect())))
    impact = {(r["table"], r["action"], r["column"]): r["rows"] for r in got.impact.collect()}
    assert {t: n for (t, action, _), n in impact.items() if action == "deleted"} == deleted
    assert {(t, c): n for (t, action, c), n in impact.items() if action == "set_null"} == nulled


def test_a_chain_longer_than_one_round(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("boss"))
    got = delete({"a": rows}, {"a": "id"}, "a", spark.createDataFrame([(30,)], "id long"), [ForeignKey("a", "boss", "a")])
    assert sorted(r["id"] for r in got.tables["a"].collect()) == list(range(30))


def test_restricting_rows_stop_the_delete(spark):
    t = frames(spark, {"a": [{"id": 1}, {"id": 2}], "b": [{"id": 1, "a": 2}]})
    edges = [ForeignKey("b", "a", "a", "restrict")]
    with pytest.raises(RestrictedDelete, match="b.a"):
        delete(t, {"a": "id", "b": "id"}, "a", t["a"].where("id = 2"), edges)
    assert delete(t, {"a": "id", "b": "id"}, "a", t["a"].where("id = 1"), edges).tables["a"].count() == 1


def test_nothing_to_delete(spark):
    t = frames(spark, {"a": [{"id": 1}], "b": [{"id": 1, "a": 1}]})
    got = delete(t, {"a": "id", "b": "id"}, "a", t["a"].limit(0), [ForeignKey("b", "a", "a")])
    assert {r["table"]: r["rows"] for r in got.impact.collect()} == {"a": 0, "b": 0}

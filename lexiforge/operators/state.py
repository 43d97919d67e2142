"""Relational state: collections, sessions, messages and memory as tables.

Updates are MERGE-shaped: they take the old table and the changes and return the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Clamps of pages, budgets, caps and breakers.
PAGE_MIN, PAGE_MAX = 1, 100
KEY_CHARS, VALUE_CHARS = 120, 500
REVIEW_EVERY, KEEP_RECENT, BREAKER = 10, 12, 3
BUDGET_LOW, BUDGET_HIGH, BUDGET_RATIO, PRESSURE = 4000, 24000, 0.30, 0.85
#: Characters that count as CJK in estimates and ratios.
CJK = r"[㐀-䶿一-鿿豈-﫿　-〿＀-￯]"


#: What memory kinds can hold, and where they land.
PROGRESS_KEYS, PROFILE_KEYS = ("last_focus", "open_questions", "next_step"), ("identity", "major", "goal")


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both; a change's non-null columns win, its null ones leave the old value."""
    new = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = old.select(*keys, *columns).join(new, keys, "full")
    return joined.select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def estimate_tokens(text: Column) -> Column:
    """One token per CJK character and one per four others."""
    n = F.length(F.coalesce(text, F.lit("")))
    others = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), CJK, ""))
    return (n - others) + F.floor(others / 4)


def newest_within(rows: DataFrame, key: str, order: str, cost: str, budget: int, floor: int) -> DataFrame:
    """The newest rows of each key: the floor is free, then as many as the budget takes; the newest
    always.  Costs are not negative, so the running sum decides without a stop flag."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    rows = rows.withColumn("rn", F.row_number().over(newest))
    charged = F.when(F.col("rn") > floor, F.col(cost)).otherwise(F.lit(0))
    rows = rows.withColumn("used", F.sum(charged).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where((F.col("rn") <= floor) | (F.col("rn") == 1) | (F.col("used") <= budget))


def history_budget(context: Column, ratio: float = BUDGET_RATIO) -> Column:
    return F.greatest(F.lit(BUDGET_LOW), F.least(F.lit(BUDGET_HIGH), F.floor(context * ratio)))


def streaks(rows: DataFrame, key: str, order: str, hit: str) -> DataFrame:
    """Adds ``streak``: rows without a hit since the last one."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.col(hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("island", island)
    inside = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("streak", F.sum((~F.col(hit)).cast("int")).over(inside)).drop("island")


def promoted(candidates: DataFrame) -> DataFrame:
    """Pending candidates (kind, key, value, collection_id, status, ...) with where they land:
    target (preferences, progress or profile; null if only marked) and field.

    A preference lands under its key.  Progress lands in its collection, if it has one and the key is
    a field.  A profile value lands under its key, or as the goal if the key is no field."""
    kind, key = F.col("kind"), F.col("key")
    progress = (kind == "progress") & F.col("collection_id").isNotNull() & key.isin(*PROGRESS_KEYS)
    target = F.when(kind == "preference", "preferences").when(progress, "progress").when(kind == "profile", "profile")
    field = F.when(kind == "profile", F.when(key.isin(*PROFILE_KEYS), key).otherwise("goal")).otherwise(key)
    return candidates.where("status = 'pending'").withColumn("target", target).withColumn("field", F.when(F.col("target").isNotNull(), field)).withColumn("status", F.lit("confirmed"))


def moved(status: Column, wanted: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The wanted status where the rules (status: what may follow) allow it, else the old one."""
    allowed = F.lit(False)
    for before, after in rules.items():
        allowed = allowed | ((status == before) & wanted.isin(*after))
    return F.when(F.coalesce(allowed, F.lit(False)), wanted).otherwise(status)


def task_status(known: Column, state: Column, message: Column, codes: dict[str, str]) -> Column:
    """not_found for a pending task that is not known, success, failed:code by the first code whose mark is in
    the message, else the state."""
    code = F.lit("unknown")
    for mark, name in reversed(codes.items()):
        code = F.when(F.lower(message).contains(mark), name).otherwise(code)
    return F.when((state == "pending") & ~F.coalesce(known, F.lit(False)), "not_found").when(state == "failed", F.concat(F.lit("failed:"), code)).otherwise(state)


def page_label(page: Column, last: Column, kind: Column) -> Column:
    """How a place is named: slide 2, sheet 2, §2, p2 or p2-3; empty without a page."""
    text = page.cast("string")
    span = F.when(last.isNotNull() & (last != page), F.concat(F.lit("p"), text, F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("p"), text))
    named = F.when(kind == "slide", F.concat(F.lit("slide "), text)).when(kind == "sheet", F.concat(F.lit("sheet "), text)).when(kind == "section", F.concat(F.lit("§"), text)).otherwise(span)
    return F.when(page.isNull(), "").otherwise(named)


def count_unit(kind: Column) -> Column:
    return F.when(kind.isin("slide", "sheet", "section"), F.concat(kind, F.lit("s"))).otherwise("pages")


def truthy(text: Column) -> Column:
    """A value's text as a boolean: 1, true, yes and y, and numbers other than 0; else false."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return t.isin("1", "true", "yes", "y") | F.coalesce(F.try_to_number(t, F.lit("9999999999.9999")) != 0, F.lit(False))

"""Forward alignment of two orders of the same text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the share of elements that must be found for pages to be carried over.
ACCEPT = 0.5


def normal(text: str | None) -> str:
    """Runs of white space as one space; case counts."""
    return " ".join((text or "").split())


def carry_pages(elements: list[str], units: list[tuple[str, int]]) -> tuple[list[int], int, int]:
    """(page of each element, found, considered): each element takes the page of the first unit from
    the cursor on that is its text; others have the page before.  The first page is that of the first
    unit with text, 1 without one."""
    kept = [(key, page) for text, page in units if (key := normal(text))]
    places: dict[str, list[int]] = {}
    for k, (key, _) in enumerate(kept):
        places.setdefault(key, []).append(k)
    cursor, page, found, considered, pages = 0, kept[0][1] if kept else 1, 0, 0, []
    for key in map(normal, elements):
        if key:
            considered += 1
            at = places.get(key, [])
            k = bisect_left(at, cursor)
            if k < len(at):
                cursor, page, found = at[k] + 1, kept[at[k]][1], found + 1
        pages.append(page)
    return pages, found, considered


def align(elements: DataFrame, units: DataFrame) -> DataFrame:
    """elements and units (document_id, ordinal, text[, page]) to (document_id, ordinal, page,
    accepted): one document's rows of both sides meet as two arrays."""
    key = elements.schema["document_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, pages, good = [], [], [], []
            for d, left, right in zip(*(batch.column(c).to_pylist() for c in ("document_id", "left", "right")), strict=True):
                got, found, considered = carry_pages([e["text"] for e in left], [(u["text"], u["page"]) for u in right or ()])
                ids += [d] * len(left)
                places += [e["ordinal"] for e in left]
                pages += got
                good += [considered > 0 and found / considered >= ACCEPT] * len(left)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("document_id").type), pa.array(places, pa.int64()), pa.array(pages, pa.int32()), pa.array(good, pa.bool_())], ["document_id", "ordinal", "page", "accepted"])

    listed = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    a = elements.groupBy("document_id").agg(listed(F.col("ordinal").cast("long").alias("ordinal"), "text").alias("left"))
    # New names on one side, as both may come from the same table.
    b = units.groupBy(F.col("document_id").alias("u_id")).agg(listed("ordinal", "text", F.col("page").cast("int").alias("page")).alias("right"))
    return a.join(b, F.col("document_id") == F.col("u_id"), "left").select("document_id", "left", "right").mapInArrow(fold, f"document_id {key}, ordinal long, page int, accepted boolean")

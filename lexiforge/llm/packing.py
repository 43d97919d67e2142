"""Best-fit packing of tokenised documents into sequences, refined by swap-based local search.

Every document's ids (with an end id) form one piece, or pieces of ``capacity`` ids where it is
longer.  Pieces are dealt at random into groups of bounded size; a group is packed best-fit
decreasing and then improved by local search: moves of one piece, exchanges of one for one and two
for one between underfull sequences, each of which fills the fuller one further (the sum of squared
fills grows), until the emptiest sequence is used up.  The sequences that are not full are then
packed once more over groups of groups.  A group's size doesn't grow with the input, so one group
loses at most a part of a sequence per some thousand pieces.

Nulls: a null text is empty and has just the end id; a null id is kept.  Repeated rows are packed
each on its own.  Empty table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stage, texts_of
from .tokens import MAX_PIECES, default_path, encoder

CAPACITY = 2048
#: Pieces to a group, about; groups to a second-level group.
GROUP_PIECES, GROUP_FAN = 8192, 16
#: Of a donor's pieces, the longest ones whose pairs are tried in exchanges.
PAIR_PIECES = 24


class Bins:
    """Bins of one capacity with pieces of whole lengths, and an index of bins by free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pieces: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.rooms = 0  # bit r: some bin has room r

    def _set_room(self, b: int, room: int) -> None:
        old = self.room[b]
        self.by_room[old].discard(b)
        if not self.by_room[old]:
            self.rooms &= ~(1 << old)
        self.room[b] = room
        self.by_room[room].add(b)
        self.rooms |= 1 << room

    def open(self) -> int:
        self.pieces.append([])
        self.room.append(self.capacity)
        self.by_room[self.capacity].add(len(self.room) - 1)
        self.rooms |= 1 << self.capacity
        return len(self.room) - 1

    def put(self, b: int, piece: int, length: int) -> None:
        self.pieces[b].append(piece)
        self._set_room(b, self.room[b] - length)

    def take(self, b: int, piece: int, length: int) -> None:
        self.pieces[b].remove(piece)
        self._set_room(b, self.room[b] + length)

    def best(self, length: int, but: int = -1) -> int:
        """The bin with the least room that takes length, the oldest of these; -1: none."""
        m = self.rooms >> length
        while m:
            low = (m & -m).bit_length() - 1
            found = [b for b in self.by_room[length + low] if b != but]
            if found:
                return min(found)
            m &= m - 1
        return -1


def best_fit(lengths: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for p in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        b = bins.best(lengths[p])
        bins.put(bins.open() if b < 0 else b, p, lengths[p])
    return bins


def local_search(bins: Bins, lengths: list[int], max_rounds: int = 4, max_partners: int = 512, max_failures: int = 16) -> Bins:
    """Empties bins where it can.  Donors are the emptiest bins; a donor's pieces move to, or are
    exchanged with shorter ones of, the fullest underfull bins.  Ends at the least possible number
    of bins, or when a round empties none; a round ends after max_failures donors in a row that
    could not be emptied.  Pairs to give are those of a donor's PAIR_PIECES longest pieces.  These bounds
    limit the search, never what is packed."""
    least = max(-(-sum(lengths) // bins.capacity), sum(1 for n in lengths if 2 * n > bins.capacity))
    live = sum(1 for p in bins.pieces if p)

    def improve(d: int, partners: list[int]) -> bool:
        """One step that makes a partner fuller at the donor's cost."""
        mine = sorted(bins.pieces[d], key=lambda p: -lengths[p])
        for p in mine:
            b = bins.best(lengths[p], but=d)
            if b >= 0 and bins.room[b] <= bins.room[d]:
                bins.take(d, p, lengths[p])
                bins.put(b, p, lengths[p])
                return True
        best: tuple[int, int, list[int], list[int]] | None = None
        pairs = [(lengths[p] + lengths[q], [p, q]) for i, p in enumerate(mine[:PAIR_PIECES]) for q in mine[i + 1 : PAIR_PIECES]]
        gives = sorted([(lengths[p], [p]) for p in mine] + pairs, key=lambda g: g[0])
        sizes = np.array([g[0] for g in gives])
        for b in partners:
            room = bins.room[b]
            if b == d or not room or not bins.pieces[b]:
                continue
            for q in bins.pieces[b]:
                k = int(np.searchsorted(sizes, lengths[q] + room, "right")) - 1
                grown = int(sizes[k]) - lengths[q] if k >= 0 else 0
                if grown > 0 and (best is None or grown > best[0]):
                    best = (grown, b, gives[k][1], [q])
                    if grown == room:
                        break
            if best and best[0] == room and best[1] == b:
                break
        if best is None:
            return False
        _, b, give, back = best
        for p in give:
            bins.take(d, p, lengths[p])
        for q in back:
            bins.take(b, q, lengths[q])
        for p in give:
            bins.put(b, p, lengths[p])
        for q in back:
            bins.put(d, q, lengths[q])
        return True

    for _ in range(max_rounds):
        before, failures = live, 0
        under = sorted((b for b in range(len(bins.room)) if 0 < bins.room[b] < bins.capacity), key=lambda b: -bins.room[b])
        for d in under:
            if live <= least:
                return bins
            if not bins.pieces[d]:
                continue
            free = sum(bins.room[b] for b in under if b != d and bins.pieces[b])
            if free < bins.capacity - bins.room[d]:
                break  # even all the room elsewhere does not take the emptiest bin
            partners = [b for b in sorted(under, key=lambda b: bins.room[b]) if bins.pieces[b]][:max_partners]
            while bins.pieces[d] and improve(d, partners):
                pass
            live -= not bins.pieces[d]
            failures = failures + 1 if bins.pieces[d] else 0
            if failures >= max_failures:
                break
        if live == before:
            break
    return bins


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, whether the bin is full) of each piece; bins are numbered from 0."""
    bins = local_search(best_fit(lengths, capacity), lengths)
    bin_of, offset, full = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), bool)
    for k, b in enumerate(b for b in range(len(bins.room)) if bins.pieces[b]):
        at = 0
        for p in sorted(bins.pieces[b]):
            bin_of[p], offset[p], full[p] = k, at, bins.room[b] == 0
            at += lengths[p]
    return bin_of, offset, full


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, max_pieces: int = MAX_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): each document's ids cut into pieces."""
    path = tokenizer or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path, max_pieces), 0
        for part in slices(batches, "text"):
            ids, bounds = encode.encode(texts_of(part, "text"), end_id)
            rows, piece, start, length, crc = [], [], [], [], []
            raw = ids.astype("<u4", copy=False)
            for r in range(part.num_rows):
                low, high = int(bounds[r]), int(bounds[r + 1])
                for k, at in enumerate(range(low, high, capacity)):
                    stop = min(high, at + capacity)
                    rows.append(r)
                    piece.append(k)
                    start.append(at - low)
                    length.append(stop - at)
                    crc.append(zlib.crc32(raw[at:stop].data))
            salt = np.arange(seen, seen + len(rows)) & 0xFFFF
            seen += len(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt, pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt int")


def packed(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[how.get("id_col", "doc_id")].dataType.simpleString()
    rows = stage(pieces(docs, capacity=capacity, **how), "pieces")
    groups = max(1, -(-rows.count() // GROUP_PIECES))
    schema = f"grp long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt int, sequence_id long, offset long, done boolean"

    def level(number: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # Sorted by value, so that a task that runs again packs the same way.
            pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece", "salt"], ascending=False, kind="stable", ignore_index=True)
            bin_of, offset, full = pack(pdf["length"].tolist(), capacity)
            base = (number << 60) + (int(pdf["grp"].iloc[0]) << 28)
            return pdf.assign(sequence_id=base + bin_of, offset=offset, done=full)[["grp", "doc_id", "piece", "start", "length", "ids_crc32", "salt", "sequence_id", "offset", "done"]]

        return run

    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)))
    first = dealt.groupBy("grp").applyInPandas(level(0), schema)
    if groups > 1:
        first = stage(first, "packed")
        rest = first.where("not done").drop("sequence_id", "offset", "done").withColumn("grp", F.floor(F.col("grp") / GROUP_FAN).cast("long"))
        first = first.where("done").unionByName(rest.groupBy("grp").applyInPandas(level(1), schema))
    return first.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Event streams that arrive in pieces: frames and tool calls of a connection over micro-batches.

A piece is bytes and may end anywhere: within a frame, a line end or a character.  A connection's state
is the unfinished tail, the pieces that came before their turn, and the tool calls by index with what has
arrived of their id, name and arguments.  Timers send a ping when a connection has been idle, and drop
one that was never closed.  The pieces of a closed connection leave no state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .turns import PING_S

EXPIRE_S = 3600
OUT = "conn_id string, kind string, n long, event string, data string, call_index int, call_id string, name string"


def take_frames(tail: bytes, piece: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(finished frames as (event, data), the new tail).  A frame ends at a blank line; comments, frames
    without data and data that is no JSON are skipped; the event without a name is message."""
    # A line end that is cut in two waits as a bare CR at the tail's end.
    parts = (tail + piece).replace(b"\r\n", b"\n").split(b"\n\n")
    found = []
    for raw in parts[:-1]:
        text = raw.decode("utf-8", "replace")
        if text.startswith(":"):
            continue
        event, data = "message", []
        for line in text.split("\n"):
            if line.startswith("event:"):
                event = line[6:].strip()
            elif line.startswith("data:"):
                data.append(line[5:].strip())
        body = "\n".join(data)
        try:
            json.loads(body)
        except ValueError:
            continue
        found.append((event, body))
    return found, parts[-1]


def call_parts(data: str) -> list[tuple[int, str, str, str]]:
    """(index, id, name, arguments) of the tool calls in one chunk of a model's answer."""
    chunk = json.loads(data)
    choices = chunk.get("choices") if isinstance(chunk, dict) else None
    delta = (choices[0].get("delta") or {}) if choices else {}
    out = []
    for call in delta.get("tool_calls") or []:
        function = call.get("function") or {}
        out.append((int(call.get("index") or 0), str(call.get("id") or ""), str(function.get("name") or ""), str(function.get("arguments") or "")))
    return out


def merged(held: tuple[str, str, str], part: tuple[str, str, str]) -> tuple[str, str, str]:
    """A call after another part of it: the last id and name that were sent, all arguments."""
    return part[0] or held[0], part[1] or held[1], held[2] + part[2]


def arguments_of(raw: str) -> str:
    """The arguments, or an empty object where they are none or broken."""
    try:
        json.loads(raw)
    except ValueError:
        return "{}"
    return raw


class Connections(StatefulProcessor):
    """Rows (conn_id, seq, piece, closed) of a connection to its frames, and at its close its tool calls."""

    def __init__(self, ping_ms: int | None = PING_S * 1000, expire_ms: int = EXPIRE_S * 1000):
        self.ping_ms, self.expire_ms = ping_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, n long, touched long, tail binary")
        self.early = handle.getMapState("early", "seq long", "piece binary, closed boolean")
        self.calls = handle.getMapState("calls", "call_index int", "id string, name string, arguments string")

    def _timers(self, following: int | None) -> None:
        """Only the timer at ``following`` is left."""
        if self.ping_ms is None:
            return
        for timer in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(int(timer))
        if following is not None:
            self.handle.registerTimer(following)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for seq, piece, closed in pdf[["seq", "piece", "closed"]].itertuples(index=False):
                self.early.updateValue((int(seq),), (bytes(piece or b""), bool(closed)))
        due, n, _, tail = self.at.get() if self.at.exists() else (0, 0, 0, b"")
        out, ended = [], False
        # Pieces that came before their turn wait for the ones between.
        while not ended and self.early.containsKey((due,)):
            piece, ended = self.early.getValue((due,))
            self.early.removeKey((due,))
            due += 1
            found, tail = take_frames(bytes(tail), bytes(piece))
            for event, data in found:
                out.append((key[0], "frame", n, event, data, None, None, None))
                n += 1
                for index, *part in call_parts(data):
                    held = self.calls.getValue((index,)) if self.calls.containsKey((index,)) else ("", "", "")
                    self.calls.updateValue((index,), merged(tuple(held), tuple(part)))
        now = timerValues.getCurrentProcessingTimeInMs() if self.ping_ms is not None else 0
        if ended:
            for index, (call_id, name, raw) in sorted((k[0], tuple(v)) for k, v in self.calls.iterator()):
                out.append((key[0], "call", n, None, arguments_of(raw), int(index), call_id, name))
                n += 1
            out.append((key[0], "end", n, None, None, None, None, None))
            self._forget()
        else:
            self.at.update((due, n, now, bytes(tail)))
            self._timers(now + (self.ping_ms or 0))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.at.exists():
            return
        due, n, touched, tail = self.at.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if now - touched >= self.expire_ms:
            self._forget()
            yield self._frame([(key[0], "expired", n, None, None, None, None, None)])
        else:
            self.handle.registerTimer(now + self.ping_ms)
            yield self._frame([(key[0], "ping", n, None, None, None, None, None)])

    def _forget(self) -> None:
        self.at.clear()
        self.early.clear()
        self.calls.clear()
        self._timers(None)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        return pdf.astype({"call_index": "Int32", "n": "int64"})

    def close(self) -> None:
        pass


def stream_connections(pieces: DataFrame, ping_ms: int | None = PING_S * 1000, expire_ms: int = EXPIRE_S * 1000) -> DataFrame:
    """A stream of pieces (conn_id string, seq long from 0, piece binary, closed boolean) to its frames, calls,
    ends, pings and expiries.  With ping_ms None there are no timers, so that a query over what is
    available can end.  The session must keep its state in RocksDB."""
    return pieces.groupBy("conn_id").transformWithStateInPandas(Connections(ping_ms, expire_ms), OUT, "Append", "None" if ping_ms is None else "ProcessingTime")

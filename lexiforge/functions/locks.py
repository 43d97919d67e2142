"""One writer at a time for a folder that all sessions share, through Spark's file system.

A lock is a file that is created only where there is none.  It names its holder, when it was taken and a
token that is larger than any before it.  A lock whose holder cannot be alive is taken over: it is
renamed away, which one session alone can do, and taken anew.  A holder that slept through its own takeover
is stopped by the token: publication refuses one that is older than what is published (fencing).
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

TTL_S = 3600


class BuildBusy(Exception):
    """Another session holds the lock."""


class StaleToken(Exception):
    """What is published has a newer token than this writer."""


def file_system(spark: SparkSession, path: str):
    """(file system of path, constructor of its paths)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none or it can't be read."""
    fs, p = file_system(spark, path)
    try:
        stream = fs.open(p(path))
    except Py4JJavaError:
        return None
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    except Py4JJavaError:
        return None
    finally:
        stream.close()


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file with its text; False where it exists."""
    fs, p = file_system(spark, path)
    try:
        stream = fs.create(p(path), False)
    except Py4JJavaError:
        if fs.exists(p(path)):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def replace_file(spark: SparkSession, path: str, over: str) -> None:
    """Renames path to ``over`` in one step, over what may be there."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    how = sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    source = hadoop.Path(path)
    hadoop.FileContext.getFileContext(source.toUri(), sc._jsc.hadoopConfiguration()).rename(source, hadoop.Path(over), how)


def process_alive(pid: int) -> bool:
    """Whether a process of this host runs; one that is not ours counts as running."""
    if pid <= 0:
        return False
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        pass
    return True


def stale_reason(text: str | None, now: float, ttl_s: float = TTL_S, host: str | None = None, alive: Callable[[int], bool] = process_alive) -> str | None:
    """Why a lock with this text may be taken over; None while it stands."""
    if text is None:
        return "unreadable"
    try:
        held = json.loads(text)
        started, owner, pid = float(held.get("started_at") or 0), str(held.get("host") or ""), int(held.get("pid") or 0)
    except (ValueError, TypeError, AttributeError):
        return "unparseable"
    if started <= 0:
        return "no_start_time"
    if now - started > ttl_s:
        return "expired"
    if owner == (host or socket.gethostname()) and not alive(pid):
        return "holder_gone"
    return None


def _token(text: str | None) -> int:
    try:
        return int(json.loads(text or "{}").get("token") or 0)
    except (ValueError, TypeError, AttributeError):
        return 0


@dataclass
class Lock:
    spark: SparkSession
    path: str
    owner: str
    token: int
    #: Why the lock before was taken over, if it was.
    took_over: str | None = None

    def held(self) -> bool:
        text = read_file(self.spark, self.path)
        try:
            return json.loads(text or "{}").get("owner") == self.owner
        except (ValueError, AttributeError):
            return False

    def release(self) -> None:
        """Gives the lock back, unless another session has it by now."""
        if self.held():
            fs, p = file_system(self.spark, self.path)
            fs.delete(p(self.path), False)

    def __enter__(self) -> Lock:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def acquire(spark: SparkSession, path: str, newest_token: int = 0, ttl_s: float = TTL_S, clock: Callable[[], float] = time.time, alive: Callable[[int], bool] = process_alive) -> Lock:
    """Takes the lock with a token above newest_token (what is published) and above the lock's before."""
    fs, p = file_system(spark, path)
    owner, seen, reason = uuid.uuid4().hex, newest_token, None
    if fs.exists(p(path)):
        text = read_file(spark, path)
        reason = stale_reason(text, clock(), ttl_s, alive=alive)
        if reason is None:
            raise BuildBusy(path)
        aside = f"{path}.stale-{owner}"
        try:
            moved = fs.rename(p(path), p(aside))
        except Py4JJavaError:
            moved = False
        if not moved:
            raise BuildBusy(path)
        if read_file(spark, aside) != text:
            # Between reading and renaming another session took it over: it goes back.
            fs.rename(p(aside), p(path))
            raise BuildBusy(path)
        seen = max(seen, _token(text))
        fs.delete(p(aside), False)
    payload = {"owner": owner, "host": socket.gethostname(), "pid": os.getpid(), "started_at": clock(), "token": seen + 1}
    if not create_file(spark, path, json.dumps(payload)):
        raise BuildBusy(path)
    return Lock(spark, path, owner, seen + 1, reason)

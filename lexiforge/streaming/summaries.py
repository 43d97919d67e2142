"""Background summaries of sessions: which are due, and a stream that makes them batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.state import BREAKER, KEEP_RECENT


def due_sessions(messages: DataFrame, sessions: DataFrame, keep: int = KEEP_RECENT, breaker: int = BREAKER) -> DataFrame:
    """messages (session_id, id) and sessions (session_id, covered, failures) to (session_id, boundary,
    due): boundary is the newest message older than the ``keep`` newest ones, if it is not covered
    yet; a session with ``breaker`` failures in a row is not due."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    old = messages.select("session_id", "id").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") == keep + 1)
    rows = sessions.join(old.select("session_id", F.col("id").alias("oldest_kept_out")), "session_id", "left")
    boundary = F.when(F.col("oldest_kept_out") > F.coalesce("covered", F.lit(0)), F.col("oldest_kept_out"))
    return rows.select("session_id", boundary.alias("boundary"), (boundary.isNotNull() & (F.coalesce("failures", F.lit(0)) < breaker)).alias("due"))


def summarized(messages: DataFrame, sessions: DataFrame, summarize: Callable[[DataFrame], DataFrame], keep: int = KEEP_RECENT) -> DataFrame:
    """The sessions after one run: summary and covered of those that succeeded, failures counted and
    set to 0 by a success.  summarize: (session_id, texts array) to (session_id, new_summary), where a
    null or blank summary is a failure."""
    due = due_sessions(messages, sessions, keep).where("due").select("session_id", "boundary")
    span = messages.join(due, "session_id").join(sessions.select("session_id", "covered"), "session_id").where((F.col("id") > F.coalesce("covered", F.lit(0))) & (F.col("id") <= F.col("boundary")))
    texts = span.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]).alias("texts"))
    made = summarize(texts).select("session_id", F.nullif(F.trim("new_summary"), F.lit("")).alias("new_summary"))
    rows = sessions.join(due, "session_id", "left").join(made, "session_id", "left")
    tried, good = F.col("boundary").isNotNull(), F.col("new_summary").isNotNull()
    return rows.select(
        "session_id",
        F.when(good, F.col("new_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(good, F.col("boundary")).otherwise(F.col("covered")).alias("covered"),
        F.when(good, 0).when(tried, F.coalesce("failures", F.lit(0)) + 1).otherwise(F.coalesce("failures", F.lit(0))).cast("int").alias("failures"),
    )


def stream_summaries(stream: DataFrame, read: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame, int], None], summarize: Callable[[DataFrame], DataFrame], checkpoint: str, keep: int = KEEP_RECENT):
    """After each batch of the message stream, the sessions that it touched are summarised if due.
    read gives the stored messages and sessions, write stores the changed sessions under the batch's
    number, so a batch that runs again overwrites itself.  Returns the stream writer."""

    def step(batch: DataFrame, number: int) -> None:
        messages, sessions = read()
        touched = batch.select("session_id").distinct()
        write(summarized(messages.join(touched, "session_id", "left_semi"), sessions.join(touched, "session_id", "left_semi"), summarize, keep), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

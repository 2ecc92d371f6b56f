"""Live tail: what is stored, then what is committed, in the order of ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.operators import ops
from stratalog.operators.predicates import long, selection
from stratalog.operators.store import Files, Index
from stratalog.plans.cursor import decode_tail, encode_tail
from stratalog.plans.query import Gap, LogQuery
from stratalog.schema import COLUMNS


def resume(index: Index, query: LogQuery, token: str | None = None, limit: int | None = None, max_bytes: int | None = None) -> tuple[list[Row], str]:
    """One page after a resume token, and the token after it.

    Without a token only the high-water mark comes back and no data is opened. A page that isn't full moves on to the
    high-water mark even when nothing matched. Events that expired before they were delivered are a gap, whatever their source.
    """
    m = index.manifest()
    newest = m.next_id - 1
    if token is None:
        return [], encode_tail(query, newest)
    after = decode_tail(query, token)
    if after < m.expired_through:
        raise Gap(f"events through {m.expired_through} have expired")
    n = limit or query.limit
    q = query.clipped(m.before_time)
    rows = ops.tail_page(index.read(q, after, m).filter(F.col("id") <= long(newest)), q, after, n, promoted=m.promoted).collect()
    if max_bytes is None:
        return rows, encode_tail(query, rows[-1]["id"] if len(rows) == n else newest)
    sized = ops.tail_page(index.read(q, after, m).filter(F.col("id") <= long(newest)), q, after, n, max_bytes, m.promoted).collect()
    if rows and not sized:
        raise Gap("the next event exceeds the page's bytes")
    full = len(sized) < len(rows) or len(rows) == n
    return sized, encode_tail(query, sized[-1]["id"] if full else newest)


def follow(index: Index, query: LogQuery, deliver: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, after: int | None = None) -> StreamingQuery:
    """Structured Streaming over the commits: each micro-batch is delivered in the order of ids, at least once.

    A new manifest starts a micro-batch; what it delivers is read from the files that the newest manifest names, from the
    last id delivered to the last committed. So batches that lost their commit are never seen, and events that were
    archived or compacted meanwhile are found where they are now. Events that expired before they were delivered are a
    Gap, which ends the stream. Late events are events: order is that of ingestion, so there is no watermark. `after` is
    the id to begin behind; without it the stream begins with all that is kept. Progress lies in the checkpoint's folder.
    """
    spark, progress = index.spark, Files(index.spark, f"{checkpoint.rstrip('/')}/delivered")
    index.files.make("manifest")

    def batch(_: DataFrame, epoch: int) -> None:
        before = [n for n in progress.names("") if n.isdigit() and int(n) < epoch]
        last = int(progress.read(max(before, key=int))) if before else after
        m = index.manifest()
        if last is None:
            last = m.expired_through
        if last < m.expired_through:
            raise Gap(f"events through {m.expired_through} have expired")
        newest, q = m.next_id - 1, query.clipped(m.before_time)
        if newest > last:
            rows = index.read(q, last, m).filter(selection(q, promoted=m.promoted) & (F.col("id") > long(last)) & (F.col("id") <= long(newest)))
            deliver(rows.select(*COLUMNS).orderBy("id"), epoch)
        progress.put(str(epoch), str(max(last, newest)))
        for n in before[:-1]:
            progress.delete(n)

    commits = spark.readStream.format("text").option("wholetext", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.json").load(index.files.uri("manifest"))
    return commits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def windowed_counts(stream: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A running histogram by level, on epoch-aligned windows; late rows beyond the watermark are left out of it."""
    t = stream.withColumn("at", F.timestamp_millis("event_time")).withWatermark("at", late)
    return t.groupBy(F.window("at", interval), "level").agg(F.count(F.lit(1)).alias("count"))

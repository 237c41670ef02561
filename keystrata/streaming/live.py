"""Logs as streams: the newest record of every key, and followers that take in a feed once."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import Future
from queue import Empty, Queue

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.resolve import latest
from keystrata.schema import DELETED, NORMAL, WRITER_QUEUE
from keystrata.sources.store import Closed, Conflict, LogStore


def latest_stream(log: DataFrame) -> DataFrame:
    """The newest record of every key of a streaming log, for complete or update mode. No watermark: order is
    the log's, not a time's, so a late record loses by its place. State has a row for each key."""
    return latest(log)


def _stream_id(store: LogStore, checkpoint: str) -> str:
    """The identity of the stream whose state is in a checkpoint: restarts keep it, a new checkpoint has another."""
    return json.loads(store.spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def follow_into(changes: DataFrame, store: LogStore, clock_ns: Callable[[], int], checkpoint: str, name: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append every micro-batch of (ord, key, value, rtype, expires_ns) to a store as one atomic batch.
    The store keeps the highest batch number of every stream, known by its checkpoint, so a batch that is
    delivered again after a failure is not taken in twice, whatever other streams wrote meanwhile."""

    def take(batch: DataFrame, number: int) -> None:
        store.append(batch, clock_ns(), applied=f"{_stream_id(store, checkpoint)}:{number}")

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def group_commit(changes: DataFrame, store: LogStore, clock_ns: Callable[[], int], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """What arrives within an interval becomes one batch of the store: writers wait for one commit, not for
    one each. How much may wait is the source's limit (maxFilesPerTrigger and the like); to close, stop
    the query after processAllAvailable."""

    def take(batch: DataFrame, number: int) -> None:
        store.append(batch, clock_ns(), applied=f"{_stream_id(store, checkpoint)}:{number}")

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Writer:
    """Group commit for single writes of one process: whatever waits is swept into one batch, without waiting
    for more. At most `queue` writes wait, beyond that write() blocks. close() commits what waits and ends."""

    def __init__(self, store: LogStore, clock_ns: Callable[[], int], queue: int = WRITER_QUEUE):
        self._store, self._clock, self._queue = store, clock_ns, Queue(queue)
        self._closed, self._lock = False, threading.Lock()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def write(self, key: bytes, value: bytes | None, expires_ns: int = 0) -> Future:
        """A future that is done once the write counts. Without a value the key is deleted."""
        with self._lock:  # nothing is queued behind the end mark
            if self._closed:
                raise Closed
            done: Future = Future()
            self._queue.put((key, value, expires_ns, done))
        return done

    def _run(self) -> None:
        going = True
        while going:
            swept = [self._queue.get()]
            while len(swept) < self._queue.maxsize:
                try:
                    swept.append(self._queue.get_nowait())
                except Empty:
                    break
            going = None not in swept
            swept = [s for s in swept if s is not None]
            try:
                if swept:
                    rows = [(i, k, v, NORMAL if v is not None else DELETED, e) for i, (k, v, e, _) in enumerate(swept)]
                    frame = self._store.spark.createDataFrame(rows, "ord bigint, key binary, value binary, rtype int, expires_ns bigint")
                    retried(self._store, lambda frame=frame: self._store.append(frame, self._clock()))
                for *_, done in swept:
                    done.set_result(None)
            except Exception as e:
                for *_, done in swept:
                    done.set_exception(e)

    def close(self) -> None:
        with self._lock:
            if not self._closed:
                self._closed = True
                self._queue.put(None)
        self._thread.join()


def retried(store: LogStore, action: Callable[[], object]) -> object:
    """The result of an action on a store, begun anew on the newest manifest whenever another writer was first."""
    while True:
        try:
            return action()
        except Conflict:
            store.refresh()


def merge_in_background(store: LogStore, clock_ns: Callable[[], int], every: float = 10.0) -> Callable[[], None]:
    """Merge what qualifies in a store again and again, one merge at a time; returns the function that ends this
    once the merge at hand is done."""
    own = LogStore(store.spark, store.path, store.segment_bytes, store.merge_trigger)
    ended = threading.Event()

    def work() -> None:
        while not ended.wait(every):
            own.refresh()
            retried(own, lambda: own.maintain(clock_ns()))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()

    def end() -> None:
        ended.set()
        thread.join()

    return end


def changed_keys(log: DataFrame) -> DataFrame:
    """Keys of a micro-batch with how often they changed: what a listener is woken for."""
    return log.groupBy("key").agg(F.count("*").alias("n"))

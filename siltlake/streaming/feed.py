"""Streams of a table's changes.

``ChangeFeed`` walks snapshots one by one: an offset is a snapshot id. For
Structured Streaming, ``stream_changes`` watches the snapshot folder as a file
source, so offsets and recovery are Spark's, and hands each snapshot's rows to a
function; with ``sink`` these go into another table exactly once, by (user,
snapshot id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import APPEND
from ..sources.table import LakeTable

MODES = ("default", "latest-full", "latest", "from-snapshot", "from-snapshot-full")


class ChangeFeed:
    """First plan by startup mode, then each further APPEND snapshot once."""

    def __init__(self, table: LakeTable, mode: str | None = None, snapshot_id: int | None = None, most_behind: int | None = None):
        mode = mode or table.options.text("scan.mode")
        snapshot_id = snapshot_id or int(table.options.text("scan.snapshot-id") or 0) or None
        if mode == "default":
            mode = "from-snapshot" if snapshot_id else "latest-full"
        if mode not in MODES:
            raise ValueError(f"unknown scan mode {mode!r}")
        if mode.startswith("from-snapshot") and not snapshot_id:
            raise ValueError(f"{mode} needs a snapshot id")
        if table.options.text("changelog-producer") not in ("none", "input"):
            raise ValueError("streams read tables without a changelog producer")
        self.table, self.mode, self.start, self.most_behind = table, mode, snapshot_id, most_behind
        self.next_id: int | None = None

    def _first(self) -> DataFrame | None:
        t, snaps = self.table, self.table.snapshots
        latest, earliest = snaps.latest_id(), snaps.earliest_id()
        if self.mode == "latest":
            self.next_id = (latest or 0) + 1
            return None
        if self.mode == "from-snapshot":
            self.next_id = max(self.start, earliest or 1)
            return None
        if latest is None:
            return None
        at = latest if self.mode == "latest-full" else self.start
        self.next_id = at + 1
        return t.read(version=at, with_kind=True)

    def poll(self) -> tuple[int, DataFrame] | None:
        """The next (snapshot id, rows), or None if there is nothing new."""
        if self.next_id is None:
            got = self._first()
            if got is not None:
                return self.next_id - 1, got
            if self.next_id is None:
                return None
        snaps = self.table.snapshots
        while (latest := snaps.latest_id()) is not None and self.next_id <= latest:
            earliest = snaps.earliest_id()
            if self.next_id < earliest:
                raise ValueError(f"snapshot {self.next_id} has expired; the earliest is {earliest}")
            if self.most_behind is not None and latest - self.next_id > self.most_behind:
                raise ValueError(f"snapshot {self.next_id} is more than {self.most_behind} behind {latest}")
            n, self.next_id = self.next_id, self.next_id + 1
            if snaps.read(n).kind == APPEND:
                return n, self.table.changes(n)
        return None

    def __iter__(self) -> Iterator[tuple[int, DataFrame]]:
        while (got := self.poll()) is not None:
            yield got


def stream_changes(table: LakeTable, handle: Callable[[DataFrame, int], None], checkpoint: str, after: int = 0, trigger: dict | None = None):
    """A streaming query that calls ``handle(rows, snapshot_id)`` for each APPEND
    snapshot past ``after``, in order. A batch that is run again after a failure
    gets the same snapshots; handlers tell by the id."""
    spark = table.spark
    table.fs.mkdirs(table.snapshots.dir)
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "snapshot-*").load(table.snapshots.dir)
    heads = files.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.kind").alias("kind"))

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.filter((F.col("kind") == APPEND) & (F.col("id") > after)).orderBy("id").collect():
            handle(table.changes(r["id"]), r["id"])

    return heads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sink(target: LakeTable, user: str) -> Callable[[DataFrame, int], None]:
    """A handler that appends rows to another table exactly once."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        target.write(rows, identifier=batch_id, user=user, ignore_empty=False)

    return handle

"""Upkeep of tables: expiring snapshots, cleaning orphans, migrating files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from ..sources import manifest as M
from ..sources.snapshot import Snapshot
from ..sources.table import Changes, LakeTable, key_text


def _metadata_of(s: Snapshot) -> set[str]:
    return {*s.base, *s.delta, *(e["path"] for e in (*s.deletions, *s.indexes))}


def expire_snapshots(table: LakeTable, retain_min: int | None = None, retain_max: int | None = None, older_than_ms: int | None = None, most: int | None = None) -> int:
    """Drop old snapshots and the files that only they use. Keeps at least
    ``retain_min``, at most ``retain_max``, and none older than the retained time
    beyond the minimum. Returns how many went."""
    o = table.options
    low = o.number("snapshot.num-retained.min") if retain_min is None else retain_min
    high = o.number("snapshot.num-retained.max") if retain_max is None else retain_max
    limit = o.number("snapshot.expire.limit") if most is None else most
    if not 1 <= low <= high:
        raise ValueError("1 <= retained min <= max is needed")
    edge = int(time.time() * 1000) - o.millis("snapshot.time-retained") if older_than_ms is None else older_than_ms
    ids = table.snapshots.ids()
    gone = []
    for k, n in enumerate(ids):
        left = len(ids) - k
        if left <= low or len(gone) >= limit:
            break
        if left > high or table.snapshots.read(n).millis < edge:
            gone.append(n)
        else:
            break
    if not gone:
        return 0
    expired, first = [table.snapshots.read(n) for n in gone], table.snapshots.read(ids[len(gone)])
    spark, root = table.spark, table.root
    # files that the expired snapshots removed, and that the first one kept does not use
    later = M.read(spark, root, [m for s in [*expired[1:], first] for m in s.delta]).filter(F.col("kind") == M.DELETE)
    used = M.live(M.read(spark, root, first.base + first.delta)).select("key")
    dead = later.join(used, "key", "left_anti").select("path").distinct()
    for r in dead.toLocalIterator():
        table.fs.delete(r["path"])
    kept = set().union(*(_metadata_of(table.snapshots.read(n)) for n in ids[len(gone) :]))
    for s in expired:
        for name in _metadata_of(s) - kept:
            table.fs.delete(f"{root}/{name}")
        table.fs.delete(table.snapshots.path(s.id))
    return len(gone)


def clean_orphans(table: LakeTable, older_than_ms: int | None = None, keep: Callable[[str], bool] | None = None, dry_run: bool = False) -> list[str]:
    """Delete data, manifest and index files that no snapshot uses and that are
    older than a day, or the time given. Tables with branches or data elsewhere
    are refused, as their files cannot all be seen from here."""
    if table.fs.list(f"{table.path}/branch") or table.fs.list(f"{table.path}/tag"):
        raise ValueError("the table has branches or tags")
    if table.options.names("data-file.external-paths"):
        raise ValueError("the table has external data files")
    edge = int(time.time() * 1000) - 86_400_000 if older_than_ms is None else older_than_ms
    snaps = [table.snapshots.read(n) for n in table.snapshots.ids()]
    names = set().union(set(), *(_metadata_of(s) for s in snaps))
    spark = table.spark
    manifests = sorted({m for s in snaps for m in (*s.base, *s.delta)})
    used = M.read(spark, table.root, manifests).filter(F.col("kind") == M.ADD).select("key").distinct()
    found = [i for i in table.fs.walk(f"{table.root}/data") if i.modified_ms < edge]
    listed = spark.createDataFrame([(i.path, key_text(i.path)) for i in found if not i.name.startswith(("_", "."))], "path string, key string")
    orphans = [r["path"] for r in listed.join(used, "key", "left_anti").collect()]
    for kind in ("manifest", "index"):
        for i in table.fs.list(f"{table.root}/{kind}"):
            if f"{kind}/{i.name}" not in names and i.modified_ms < edge:
                orphans.append(i.path)
    orphans = sorted(p for p in orphans if keep is None or not keep(p))
    for p in [] if dry_run else orphans:
        table.fs.delete(p)
    return orphans


def migrate_files(table: LakeTable, paths: list[str], partition: dict[str, str | None] | None = None, **commit):
    """Move existing data files into an append table without buckets."""
    if table.has_keys or table.options.number("bucket") != -1:
        raise ValueError("files migrate into append tables without buckets only")
    fmt = table.options.text("file.format")
    folder = f"{table._data_root()}/{uuid.uuid4().hex}"
    for p in paths:
        name = p.rsplit("/", 1)[-1]
        if not table.fs.rename(p, f"{folder}/{uuid.uuid4().hex[:8]}-{name}"):
            raise OSError(f"cannot move {p}")
    entries = table._describe(folder, fmt, None, 0)
    for e in entries:
        e["partition"] = dict(partition or {})
    return table.commit(Changes(added=entries, schema_id=table.schema.id), **commit)

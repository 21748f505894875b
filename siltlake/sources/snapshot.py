"""Snapshots: numbered JSON files, published atomically."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from .fs import Files

APPEND, OVERWRITE, COMPACT, ANALYZE = "APPEND", "OVERWRITE", "COMPACT", "ANALYZE"


@dataclass
class Snapshot:
    id: int
    schema_id: int
    base: list[str]
    delta: list[str]
    kind: str
    user: str
    identifier: int | None
    millis: int
    total_rows: int
    delta_rows: int
    total_bytes: int = 0
    deletions: list[dict] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    watermark: int | None = None
    next_row_id: int | None = None
    next_sequence: int = 0
    properties: dict[str, str] = field(default_factory=dict)
    statistics: dict | None = None
    #: the last identifier that each user committed with; expiry does not forget it
    users: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        return cls(**json.loads(text))


class Snapshots:
    def __init__(self, files: Files, root: str):
        self.files, self.dir = files, f"{root}/snapshot"

    def path(self, n: int) -> str:
        return f"{self.dir}/snapshot-{n}"

    def ids(self) -> list[int]:
        return sorted(int(i.name.split("-")[1]) for i in self.files.list(self.dir) if i.name.startswith("snapshot-"))

    def read(self, n: int) -> Snapshot:
        if not self.files.exists(self.path(n)):
            ids = self.ids()
            raise ValueError(f"snapshot {n} does not exist; there are {ids[0]} to {ids[-1]}" if ids else f"snapshot {n} does not exist; the table is empty")
        return Snapshot.from_json(self.files.read(self.path(n)))

    def latest_id(self) -> int | None:
        hint = self.files.read_hint(f"{self.dir}/LATEST") or ""
        n = int(hint) if hint.isdecimal() else 0
        # a hint may lag behind, or be of a time before an expiry
        if n and self.files.exists(self.path(n)):
            while self.files.exists(self.path(n + 1)):
                n += 1
            return n
        ids = self.ids()
        return ids[-1] if ids else None

    def latest(self) -> Snapshot | None:
        n = self.latest_id()
        return None if n is None else self.read(n)

    def earliest_id(self) -> int | None:
        ids = self.ids()
        return ids[0] if ids else None

    def publish(self, s: Snapshot) -> bool:
        self.files.mkdirs(self.dir)
        if not self.files.publish(self.path(s.id), s.to_json()):
            return False
        self.files.write_hint(f"{self.dir}/LATEST", str(s.id))
        return True

    def at_or_before(self, millis: int) -> Snapshot | None:
        """The last snapshot made at or before a time, by bisection."""
        ids = self.ids()
        low, high, best = 0, len(ids) - 1, None
        while low <= high:
            mid = (low + high) // 2
            s = self.read(ids[mid])
            if s.millis <= millis:
                best, low = s, mid + 1
            else:
                high = mid - 1
        return best

    def last_of_user(self, user: str) -> int | None:
        """The last identifier that a user committed with, if any."""
        last = self.latest()
        return last.users.get(user) if last else None

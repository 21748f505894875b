"""Table options: names, defaults and parsing."""

from __future__ import annotations

import re
from typing import Any

from ..operators.merge import MergeSpec

#: Option names and their defaults (fixed values).
DEFAULTS: dict[str, str] = {
    "bucket": "-1",
    "bucket-key": "",
    "branch": "main",
    "changelog-producer": "none",
    "commit.max-retries": "10",
    "data-evolution.enabled": "false",
    "data-file.external-paths": "",
    "deletion-vectors.enabled": "false",
    "file.compression": "zstd",
    "file.format": "parquet",
    "ignore-delete": "false",
    "manifest.merge-min-count": "30",
    "merge-engine": "deduplicate",
    "metadata.stats-mode": "full",
    "partial-update.remove-record-on-delete": "false",
    "partial-update.remove-record-on-sequence-group": "",
    "partition.default-name": "__DEFAULT_PARTITION__",
    "row-tracking.enabled": "false",
    "scan.fallback-branch": "",
    "scan.mode": "default",
    "scan.snapshot-id": "",
    "sequence.field": "",
    "sequence.field.sort-order": "ascending",
    "snapshot.expire.limit": "10",
    "snapshot.num-retained.max": "2147483647",
    "snapshot.num-retained.min": "10",
    "snapshot.time-retained": "1 h",
    "sort-engine": "loser-tree",
    "target-file-size": "256 mb",
}
_TRUE, _FALSE = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")
_SIZES = {"b": 0, "": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
_TIMES = {"ms": 1, "s": 1000, "sec": 1000, "min": 60_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


class Options:
    """Options of the table's schema, overlaid by those of the call."""

    def __init__(self, *layers: dict[str, Any] | None):
        self.given: dict[str, str] = {}
        for layer in layers:
            self.given |= {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (layer or {}).items()}

    def text(self, name: str) -> str:
        return self.given.get(name, DEFAULTS.get(name, ""))

    def flag(self, name: str) -> bool:
        value = self.text(name).lower()
        if value not in (*_TRUE, *_FALSE):
            raise ValueError(f"{name} is not a boolean: {value}")
        return value in _TRUE

    def number(self, name: str) -> int:
        return int(self.text(name))

    def names(self, name: str) -> list[str]:
        return [x.strip() for x in self.text(name).split(",") if x.strip()]

    def size(self, name: str) -> int:
        m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", self.text(name).lower())
        if not m or m[2] not in _SIZES:
            raise ValueError(f"{name} is not a size: {self.text(name)}")
        return int(m[1]) << _SIZES[m[2]]

    def millis(self, name: str) -> int:
        m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", self.text(name).lower())
        if not m or m[2] not in _TIMES:
            raise ValueError(f"{name} is not a duration: {self.text(name)}")
        return int(m[1]) * _TIMES[m[2]]

    def merge_spec(self, keys: list[str]) -> MergeSpec:
        aggregators, ignored, groups = {}, set(), {}
        for k, v in self.given.items():
            if m := re.fullmatch(r"fields\.(.+)\.aggregate-function", k):
                aggregators[m[1]] = v
            elif (m := re.fullmatch(r"fields\.(.+)\.ignore-retract", k)) and Options({k: v}).flag(k):
                ignored.add(m[1])
            elif m := re.fullmatch(r"fields\.(.+)\.sequence-group", k):
                groups[tuple(x.strip() for x in m[1].split(","))] = [x.strip() for x in v.split(",")]
        order = self.text("sequence.field.sort-order")
        if order not in ("ascending", "descending"):
            raise ValueError(f"unknown sort order {order!r}")
        return MergeSpec(
            keys=keys, engine=self.text("merge-engine"), sequence=self.names("sequence.field"), descending=order == "descending",
            ignore_delete=self.flag("ignore-delete"), aggregators=aggregators, default_aggregator=self.given.get("fields.default-aggregate-function"),
            ignore_retract=ignored, groups=groups, remove_on_delete=self.flag("partial-update.remove-record-on-delete"),
            remove_on_group=set(self.names("partial-update.remove-record-on-sequence-group")),
        )

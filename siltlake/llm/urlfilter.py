"""URL filters: a trie over reversed host labels and path segments.

The trie is broadcast behind a check of its size, and each URL walks it once.
Precedence: the deepest host wins, then the longest path; between an allow and a
block entry for the same place, block wins.

Defined results: null and URLs without "://" have empty host and path, match no
rule and get the default verdict; repeated rows are judged alike; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: More rules, or characters of them, than this are refused: a trie takes about a
#: kilobyte a rule in each worker.
MAX_RULES, MAX_CHARACTERS = 200_000, 32_000_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_END_HOST, _END_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _END_HOST.search(rest)
    cut = m.start() if m else len(rest)
    return rest[:cut].translate(_LOWER), _END_PATH.split(rest[cut:], maxsplit=1)[0]


@dataclass
class PathNode:
    """Below a host: whole segments lead on, a rule may end here, and what is
    left of a rule's last, unfinished segment is kept as a fragment."""

    next: dict[str, PathNode] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: lengths of the fragments, longest first: a URL is looked up once for each
    sizes: list[int] = field(default_factory=list)


@dataclass
class HostNode:
    next: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = HostNode()
        for verdict, host, path in rules:
            self._add(verdict, host, path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = self.root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.next.setdefault(label, HostNode())
        node.paths = here = node.paths or PathNode()
        *whole, fragment = path.split("/")
        for segment in whole:
            here = here.next.setdefault(segment, PathNode())
        if fragment not in here.ends or verdict == "block":
            here.ends[fragment] = (f"{host.translate(_LOWER)}{path}", verdict)
            if len(fragment) not in here.sizes:
                here.sizes = sorted([*here.sizes, len(fragment)], reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, else None."""
        fits, node = [], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.next.get(label)
            if node is None:
                break
            if node.paths is not None:
                fits.append(node.paths)
        for paths in reversed(fits):
            if found := self._match_path(paths, path):
                return found
        return None

    @staticmethod
    def _match_path(here: PathNode, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            if here.ends:
                left = len(path) - at
                best = next((e for n in here.sizes if n <= left and (e := here.ends.get(path[at : at + n]))), best)
            cut = path.find("/", at)
            if cut < 0 or (step := here.next.get(path[at:cut])) is None:
                return best
            here, at = step, cut + 1


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict."""
    if len(rules) > MAX_RULES or sum(len(h) + len(p) for _, h, p in rules) > MAX_CHARACTERS:
        raise ValueError(f"{len(rules)} rules exceed the broadcast bound of {MAX_RULES} rules and {MAX_CHARACTERS} characters")
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            hits = [trie.match(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([h and h[0] for h in hits], pa.string()),
                    pa.array([h[1] if h else default for h in hits], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")

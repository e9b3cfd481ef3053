"""URL rules in a trie over reversed host labels and path segments.

The trie is made of the given rules only, so its size is theirs, and it is broadcast.
A rule fits its host and all subdomains of it where the path starts with the rule's
path. The rule with the longest host wins, and among those the longest path.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rules broadcast at most; more would need a join.
MOST = 2_000_000


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both are empty where it is null or has no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


class Trie:
    """Nodes by host label from the right; each has a trie of path segments of its own."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, start = (slash + path).split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            # what follows the last slash of the rule is the start of a segment; starts are kept by their length
            node.setdefault("ends", {}).setdefault(len(start), {}).setdefault(start, (rule, verdict))
        self._sort(self.root)

    def _sort(self, root: dict) -> None:
        """Longest starts first at each node."""
        todo = [root]
        while todo:
            node = todo.pop()
            if "ends" in node:
                node["ends"] = sorted(node["ends"].items(), reverse=True)
            todo += [*node.get("labels", {}).values(), *node.get("next", {}).values(), *([node["paths"]] if "paths" in node else [])]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that fits best, with its verdict."""
        found = self._path(self.root, path)
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            found = self._path(node, path) or found
        return found

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        node, found, at = node.get("paths"), None, 0
        while node is not None:
            for size, starts in node.get("ends", ()):
                if (rule := starts.get(path[at : at + size])) is not None:
                    found = rule
                    break
            end = path.find("/", at)
            if end < 0:
                break
            node, at = node.get("next", {}).get(path[at:end]), end + 1
        return found


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    pages: has ``page_id`` and ``url``; other columns are not read. rules: pairs of
    verdict and ``host/path``. Where no rule fits, rule is null and the verdict is
    ``default``. A null url has an empty host and path; an empty host fits no rule but
    one without a host. Of two equal rules the first counts. Repeated rows give a row
    each, an empty table none.
    """
    if len(rules) > MOST:
        raise ValueError(f"at most {MOST} rules can be broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find, out = trie.value.find, [[], [], [], []]
        for url in batch.column(1).to_pylist():
            host, path = parts(url)
            rule, verdict = find(host, path) or (None, default)
            for column, value in zip(out, (host, path, rule, verdict)):
                column.append(value)
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.string()) for c in out)], names=["page_id", "host", "path", "rule", "verdict"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), run, SCHEMA, rows=4096)

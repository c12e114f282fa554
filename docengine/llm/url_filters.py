"""URL filters as a sort-merge range join.

A host is keyed by its labels in reverse order, each closed by a dot, so a host
and all its subdomains are one interval of keys.  URLs are range-partitioned
and sorted by that key; one sweep over a partition advances through the rules
in the same order and keeps a stack of the nested rules whose interval is open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules that one sweep holds; a longer list is swept in blocks of this size.
BLOCK = 200_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return reversed_host(self.host)

    @property
    def priority(self) -> int:
        """Of fitting rules the one with the highest priority wins: longest text, block before allow, longest host."""
        return (2 * len(self.text) + (self.verdict == "block") << 20) + len(self.host)


def reversed_host(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


def parse_rule(line: str) -> Rule:
    """``allow www.example.com/en/`` and the like."""
    verdict, _, rest = line.strip().partition(" ")
    host, slash, path = rest.strip().partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), _AZ, _az)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def reversed_host_column(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _priorities(rule: pa.Array, verdict: pa.Array) -> np.ndarray:
    """The priority of each row's rule so far; -1 for none."""
    length, slash = pc.utf8_length(rule), pc.find_substring(rule, "/")
    host = pc.if_else(pc.less(slash, 0), length, slash)
    blocks = pc.cast(pc.equal(verdict, "block"), pa.int64())
    length, host = pc.cast(length, pa.int64()), pc.cast(host, pa.int64())
    priority = pc.add(pc.multiply(pc.add(pc.multiply(length, 2), blocks), 1 << 20), host)
    return np.array(pc.fill_null(priority, -1))


def _sweep(rules: list[tuple[str, str, str, str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rules: (key, path, text, verdict, priority), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = 0, []  # stack: rules whose host interval holds the current key, outer first
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key, path = batch.column("key"), batch.column("path")
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            starts = np.append(np.flatnonzero(new), n)
            best = np.full(n, -1, np.int64)
            rank = _priorities(batch.column("rule"), batch.column("verdict"))
            active = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                k = key[int(lo)].as_py()
                while stack and not k.startswith(rules[stack[-1]][0]):
                    stack.pop()
                while at < len(rules) and rules[at][0] <= k:
                    while stack and not rules[at][0].startswith(rules[stack[-1]][0]):
                        stack.pop()
                    if k.startswith(rules[at][0]):
                        stack.append(at)
                    at += 1
                active.append(tuple(stack))
            groups: dict[tuple, list[int]] = {}
            for g, rule_set in enumerate(active):
                groups.setdefault(rule_set, []).append(g)
            for rule_set, members in groups.items():
                rows = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in members])
                paths = path.take(pa.array(rows))
                for r in rule_set:
                    fits = pc.starts_with(paths, pattern=rules[r][1]).to_numpy(zero_copy_only=False)
                    hit = rows[fits & (rank[rows] < rules[r][4])]
                    best[hit], rank[hit] = r, rules[r][4]
            better = pa.array(best >= 0)
            found = [rules[r] if r >= 0 else (None,) * 5 for r in best.tolist()]
            rule = pc.if_else(better, pa.array([f[2] for f in found], pa.string()), batch.column("rule"))
            verdict = pc.if_else(better, pa.array([f[3] for f in found], pa.string()), batch.column("verdict"))
            kept = [batch.column(c) for c in ("page_id", "host", "path", "key")]
            yield pa.RecordBatch.from_arrays([*kept, rule, verdict], names=["page_id", "host", "path", "key", "rule", "verdict"])

    return run


def match_urls(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", block: int = BLOCK) -> DataFrame:
    """The longest rule that fits each URL, and its verdict.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's.  Of fitting rules the one with the longest text wins; of equal
    length, ``block`` before ``allow``, then the longer host; the order and the
    blocks of the rules do not matter.  Returns one row per input row:
    ``page_id, host, path, rule, verdict``.

    A null URL, or one without ``://``, has an empty host and path and fits
    only rules with an empty host.  Repeated rows are judged one by one; other
    columns of ``pages`` are not read; an empty table gives an empty result.
    A rule list longer than ``block`` is swept block by block over all rows,
    each sweep improving on the one before, so none holds more rules than that.
    """
    ranked = sorted({(r.key, r.path, r.text, r.verdict, r.priority) for r in rules})
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", reversed_host_column(F.col("host")))
    # The page id in the splitters lets one host spread over many partitions.
    urls = urls.repartitionByRange("key", "page_id").sortWithinPartitions("key")
    schema = "page_id long, host string, path string, key string, rule string, verdict string"
    out = urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    for lo in range(0, len(ranked), block):
        # A sweep keeps the order of its rows, so the next one needs no new sort.
        out = out.mapInArrow(_sweep(ranked[lo : lo + block]), schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

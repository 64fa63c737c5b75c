"""URL filters: a sort-merge range join of reversed-host keys with nested prefix rules.

The canonical key of a host is its labels in reverse, each closed by a full stop
(``m.example.com`` is ``com.example.m.``). The hosts that a rule covers, its own and
all subdomains, are then the one interval of keys that begin with the rule's key, and
two such intervals nest or are disjoint. Hosts and rules are swept in key order with
a stack of the rules whose interval holds the current host. Paths are prefixes too and
are looked up by length at each host on the stack.

No row is shuffled: each Arrow batch is sorted and merged with the sorted rules, so
a host with a third of all rows is work for as many tasks as the scan has. Rules go to
the tasks in blocks of ``BLOCK`` at most, one pass per block, so what is sent is bounded
at any number of rules.

Cases: a null url, or one without ``://``, has empty host and path and fits only a
rule with an empty host and path. Of equal rules the first wins; of rules of equal
length the one with the longer host, however the rules are cut into blocks. Rows are never dropped or merged; other columns of
``pages`` are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, own

#: Most rules in one pass.
BLOCK = 200_000


def host_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


class Sweep:
    """Rules in key order: per host its paths by length, and a sweep over hosts."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        nodes: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            host = host.lower()
            nodes.setdefault(host_key(host), {}).setdefault(path, (host + path, verdict))
        self.nodes = [(k, nodes[k], sorted({len(p) for p in nodes[k]}, reverse=True), max(len(k) - 1, 0)) for k in sorted(nodes)]

    def active(self, keys: list[str]) -> list[tuple]:
        """For each of the sorted keys, the nodes whose interval holds it, outermost first."""
        stack: list = []
        out, at, n = [], 0, len(self.nodes)
        for key in keys:
            while at < n and self.nodes[at][0] <= key:
                node = self.nodes[at]
                at += 1
                while stack and not node[0].startswith(stack[-1][0]):
                    stack.pop()
                stack.append(node)
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            out.append(tuple(stack))
        return out

    @staticmethod
    def best(nodes: tuple, path: str, most: tuple[int, int] = (-1, -1)) -> tuple[str, str, int, int] | None:
        """The longest fitting rule above ``most`` (its length, its host's length); of equal length the one with the longer host."""
        found = None
        for _, paths, lengths, host_len in nodes:
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if (host_len + n, host_len) > most:
                        most = (host_len + n, host_len)
                        found = (*hit, *most)
                    break
        return found


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; ``rules`` holds (host, path, verdict).

    The rules are the caller's configuration and are held by the driver.
    """
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    rows = own(pages, id_col, url_col).select(
        F.col(id_col),
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"),
        F.lit(-1).alias("size"),  # of the rule so far: its length, and its host's
        F.lit(-1).alias("host_size"),
    )
    schema = rows.schema
    blocks = [rules[i : i + BLOCK] for i in range(0, len(rules), BLOCK)]
    for block in blocks:
        rows = rows.mapInPandas(_pass(rows.sparkSession.sparkContext.broadcast(block)), schema)
    return rows.drop("size", "host_size")


def _pass(rules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep(rules.value)
        for b in batches:
            codes, hosts = pd.factorize(b["host"])
            order = sorted(range(len(hosts)), key=lambda i, k=[host_key(h) for h in hosts]: k[i])
            nodes: list = [()] * len(hosts)
            for i, x in zip(order, sweep.active([host_key(hosts[i]) for i in order])):
                nodes[i] = x
            out = []
            for c, path, *so_far in zip(codes, b["path"], b["rule"], b["verdict"], b["size"], b["host_size"]):
                out.append(Sweep.best(nodes[c], path, (so_far[2], so_far[3])) or so_far)
            yield b.assign(**dict(zip(("rule", "verdict", "size", "host_size"), zip(*out)))) if out else b

    return run

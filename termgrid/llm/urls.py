"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule is ``host/path``.  It fits its host and every subdomain when the url's
path starts with the rule's path; a rule without a slash fits any path.  Of the
rules that fit, the longest decides (more characters; then more host labels);
the same rule in both lists blocks.  The trie is broadcast; its size is bounded
by ``max_rules``, beyond which the operator refuses to run.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the default verdict; an empty table gives an empty table; repeated rows
each get their verdict; input columns that clash with the four output columns
(in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.llm.common import unused, without

OUTPUT = ("host", "path", "rule", "verdict")


class Node:
    __slots__ = ("children", "paths", "ends")

    def __init__(self):
        self.children: dict[str, Node] = {}  # by host label or path segment
        self.paths: Node | None = None  # where the path part of a host's rules begins
        self.ends: list[tuple[str, str, str]] = []  # (start of the next segment, rule, verdict)


def build_trie(rules: Iterable[tuple[str, str]]) -> Node:
    root = Node()
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.split(".")):
            node = node.children.setdefault(label, Node())
        node.paths = node.paths or Node()
        node, segments = node.paths, (slash + path).split("/")
        for segment in segments[:-1]:
            node = node.children.setdefault(segment, Node())
        node.ends.append((segments[-1], rule, verdict))
    return root


def longest_rule(trie: Node, host: str, path: str) -> tuple[str | None, str | None]:
    best = (-1, -1, False)
    found: tuple[str | None, str | None] = (None, None)
    segments = path.split("/")
    node: Node | None = trie
    for depth, label in enumerate(reversed(host.split(".")), 1):
        node = node.children.get(label)
        if node is None:
            break
        below = node.paths
        for segment in segments if below else ():
            for start, rule, verdict in below.ends:
                rank = (len(rule), depth, verdict == "block")
                if segment.startswith(start) and rank > best:
                    best, found = rank, (rule, verdict)
            below = below.children.get(segment)
            if below is None:
                break
    return found


def with_url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    rest = F.when(
        F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")
    ).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return pages.withColumns({
        "host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def filter_urls(
    pages: DataFrame, allow: Iterable[str], block: Iterable[str], url: str = "url", default: str = "allow",
    max_rules: int = 1_000_000,
) -> DataFrame:
    """Add host, path, the deciding rule (null: none) and the verdict to every row."""
    rules = [(r, "allow") for r in allow] + [(r, "block") for r in block]
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    if default not in ("allow", "block"):
        raise ValueError("default is 'allow' or 'block'")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [longest_rule(trie.value, h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}, dtype=object)

    kept = [c for c in without(pages, *(o for o in OUTPUT if o.lower() != url.lower())).columns]
    parts = with_url_parts(without(pages, *(o for o in OUTPUT if o.lower() != url.lower())), url)
    both = unused(parts, "_judged")
    judged = parts.withColumn(both, judge("host", "path"))
    return judged.select(*[f"`{c}`" for c in kept], "host", "path", f"{both}.rule", f"{both}.verdict")

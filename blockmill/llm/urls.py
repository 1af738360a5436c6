"""Allow and block lists for urls, held as one trie.

The trie goes from the last host label to the first and then along the path
segments. A rule ends at a host node with a run of whole segments and the
beginning of the next one. Of the rules on the way of a url the longest, host and
path together, decides; of equally long ones the one with the longer host.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules a trie may hold before it is refused for broadcasting (about 1 GB).
MAX_RULES = 2_000_000

SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass
class _Paths:
    below: dict[str, _Paths] = field(default_factory=dict)
    #: beginning of the next segment -> (rule, verdict)
    starts: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: lengths of these beginnings, longest first
    lengths: list[int] = field(default_factory=list)

    def longest(self, segment: str) -> tuple[str, str] | None:
        """The longest beginning of a segment: one look-up per length, however many there are."""
        for length in self.lengths:
            if length <= len(segment) and (entry := self.starts.get(segment[:length])):
                return entry
        return None


@dataclass
class _Host:
    below: dict[str, _Host] = field(default_factory=dict)
    paths: _Paths | None = None
    #: a rule with an empty path: fits every path of the host
    whole: tuple[str, str] | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        """``rules``: (host, path, verdict); of equal ones a block counts."""
        self._root, n = _Host(), 0
        for host, path, verdict in rules:
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules; split the list by top-level label")
            node = self._root
            for label in reversed(host.split(".")):
                node = node.below.setdefault(label, _Host())
            entry = (host + path, verdict)
            if not path:
                if node.whole is None or verdict == "block":
                    node.whole = entry
                continue
            first, *rest = path.split("/")
            if first:
                raise ValueError(f"the path of a rule starts with a slash: {path}")
            place = node.paths = node.paths or _Paths()
            for segment in rest[:-1]:
                place = place.below.setdefault(segment, _Paths())
            if rest[-1] not in place.starts or verdict == "block":
                place.starts[rest[-1]] = entry
            if len(rest[-1]) not in place.lengths:
                place.lengths = sorted([*place.lengths, len(rest[-1])], reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and verdict of the longest match."""
        best, node = None, self._root
        segments = path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            here = node.whole
            place = node.paths
            for segment in segments:
                if place is None:
                    break
                here = place.longest(segment) or here
                place = place.below.get(segment)
            if here and (best is None or len(here[0]) >= len(best[0])):
                best = here
        return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, SPLIT_URL, 1), letters, letters.lower())
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, SPLIT_URL, 2), F.lit(""))


def judge_urls(
    df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (replacing such columns).

    The longest rule counts (see above), and of two equal ones a block.
    Null urls and urls without ``://`` have an empty host and path, no rule and
    the verdict ``otherwise``. The path must begin with the rule's, so a url
    without any path does not fit a rule whose path is ``/``. Rows stay one to
    one; nothing is shuffled. The trie is broadcast: it holds at most
    ``MAX_RULES`` rules.
    """
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [trie.find(h, p) or (None, otherwise) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    parts = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = parts.withColumn("_judged", judge("host", "path"))
    return judged.withColumns({c: F.col(f"_judged.{c}") for c in ("rule", "verdict")}).drop("_judged")

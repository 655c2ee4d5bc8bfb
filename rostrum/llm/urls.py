"""Allow and block entries for URLs, in a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the pickled trie that are broadcast; a longer rule list goes to `judge_by_join`.
MAX_TRIE_BYTES = 64 << 20

Rule = tuple[str, str, str]  # host, path prefix, allow or block


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Trie:
    """Nodes are dicts: host labels from the right, then path segments; None holds the rules that end there.

    A rule's path is a string prefix, so its last segment may be the start of a longer one: the
    rules of a node are kept with that last part and compared by prefix.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, part = path.split("/")
            node = node.setdefault(("path",), {})
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[part] = (f"{host}{path}", verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match: most host labels first, then the longest path."""
        found, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            found = self._along(node.get(("path",)), segments) or found
        return found

    @staticmethod
    def _along(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for segment in segments:
            if node is None:
                break
            ends = node.get(None)
            if ends:
                fits = [p for p in ends if segment.startswith(p)]
                if fits:
                    found = ends[max(fits, key=len)]
            node = node.get(segment)
        return found


def judge(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of these names are replaced.

    One narrow pass with a broadcast trie. Its size is measured: a trie above `max_trie_bytes` is
    refused, and `judge_by_join` takes rule tables of any size. A url that no rule fits gets
    `default` and a null rule; so do nulls and urls without `://`.
    """
    trie = Trie(rules)
    if (size := len(pickle.dumps(trie.root))) > max_trie_bytes:
        raise ValueError(f"the trie has {size} bytes; use judge_by_join")
    shared = pages.sparkSession.sparkContext.broadcast(trie.root)

    @F.pandas_udf("rule string, verdict string")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        local = Trie(())
        local.root = shared.value
        for host, path in parts:
            hits = [local.match(h, p) or (None, default) for h, p in zip(host, path)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"])

    kept = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    host, path = host_and_path(F.col(url_col))
    parted = kept.withColumns({"host": host, "path": path}).withColumn("_hit", walk("host", "path"))
    return parted.withColumns({"rule": F.col("_hit.rule"), "verdict": F.col("_hit.verdict")}).drop("_hit")


def judge_by_join(pages: DataFrame, rules: DataFrame, key: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for a rule table (host, path, verdict) of any size; `key` names a url.

    Each url offers its host suffixes, as long as rules have them; an equi-join brings the rules of those hosts, the longest one
    that fits stays. Hosts with many rules or urls are split by Spark's skew handling.
    """
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    first = F.greatest(F.lit(1), F.size(labels) - deepest + 1)
    suffix = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    offers = named.select(key, "host", "path", F.explode(suffix).alias("_host"))
    table = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    fits = offers.join(table, "_host").filter(F.expr("startswith(path, _path)"))
    rank = F.struct(F.size(F.split("_host", r"\.", -1)), F.length("_path"))
    best = fits.groupBy(key).agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict")), rank).alias("_hit"))
    return named.join(best, key, "left").select(key, "host", "path", "_hit.rule", F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))

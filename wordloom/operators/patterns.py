"""Many strings looked for in many strings, by automata over blocks of bounded size (JO-5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 20_000  # patterns of an automaton, about
SLICE = 100_000  # texts that an automaton reads in one task, about


class Automaton:
    """Follows a text letter by letter to the longest end of it that begins a pattern; what patterns end there is on the way of shorter ends."""

    def __init__(self, patterns: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.at = []  # the node of each pattern
        for p in patterns:
            node = 0
            for c in p:
                to = self.step[node].get(c)
                if to is None:
                    to = self.step[node][c] = len(self.step)
                    self.step.append({})
                node = to
            self.at.append(node)
        self.shorter, self.order = [0] * len(self.step), [0]
        for node in self.order:  # by depth; grows while it is read
            for c, to in self.step[node].items():
                self.order.append(to)
                if node:
                    self.shorter[to] = self.next(self.shorter[node], c)

    def next(self, node: int, c: str) -> int:
        while (to := self.step[node].get(c)) is None:
            if not node:
                return 0
            node = self.shorter[node]
        return to

    def least_in(self, texts: list[str], value: list) -> list:
        """For each text the least value of the patterns in it, or None. Each node knows the least of all that end there, so matches aren't listed."""
        least: list = [None] * len(self.step)
        for node, v in zip(self.at, value):
            least[node] = v if least[node] is None else min(v, least[node])
        for node in self.order:
            if (v := least[self.shorter[node]]) is not None and (least[node] is None or v < least[node]):
                least[node] = v
        out = []
        for t in texts:
            node, best = 0, None
            for c in t:
                node = self.next(node, c)
                if (v := least[node]) is not None and (best is None or v < best):
                    best = v
            out.append(best)
        return out

    def first_with(self, texts: list[str]) -> list[int | None]:
        """For each pattern the number of the first text that has it, or None. A pattern that was found is skipped from then on."""
        found: list[int | None] = [None] * len(self.step)
        ends = [False] * len(self.step)
        for node in self.at:
            ends[node] = True
        open_ = list(range(len(self.step)))  # the nearest shorter end, itself included, with a pattern that wasn't found yet
        for node in self.order[1:]:
            if not ends[node]:
                open_[node] = self.shorter[node]

        def nearest(node: int) -> int:
            top = node
            while open_[top] != top:
                top = open_[top]
            while open_[node] != top:
                open_[node], node = top, open_[node]
            return top

        for k, t in enumerate(texts):
            node = 0
            for c in t:
                node = self.next(node, c)
                while hit := nearest(node):
                    found[hit], open_[hit] = k, self.shorter[hit]
        return [found[node] for node in self.at]


def _blocks(df: DataFrame, by: str, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // size))
    return df.withColumn("own", F.pmod(F.xxhash64(by), F.lit(n)).cast("int")), n


def _met(patterns: DataFrame, texts: DataFrame, find) -> DataFrame:
    """find(patterns, texts) for each block of patterns with each slice of texts, a task of its own: (key, pos)."""
    p, blocks = _blocks(patterns, "pattern", BLOCK)
    t, slices = _blocks(texts, "text", SLICE)
    p = p.withColumnRenamed("own", "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    t = t.withColumnRenamed("own", "slice").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return p.groupBy("block", "slice").cogroup(t.groupBy("block", "slice")).applyInPandas(find, "key string, pos long")


def first_text_with(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, pos): for each of patterns (pattern) the least pos of texts (text, pos) that have it; patterns that none has are left out."""

    def find(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos", kind="stable")
        found = pd.Series(Automaton(p["pattern"].tolist()).first_with(t["text"].tolist()), dtype="Int64")
        has = found.notna()
        return pd.DataFrame({"key": p["pattern"].reset_index(drop=True)[has], "pos": t["pos"].to_numpy()[found[has].astype(int)]})

    return _met(patterns, texts, find).groupBy("key").agg(F.min("pos").alias("pos"))


def first_pattern_in(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, pos): for each of texts (text) the least pos of patterns (pattern, pos) in it; texts without one are left out."""

    def find(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        least = Automaton(p["pattern"].tolist()).least_in(t["text"].tolist(), p["pos"].tolist())
        return pd.DataFrame({"key": t["text"].to_numpy(), "pos": pd.array(least, dtype="Int64")}).dropna()

    return _met(patterns, texts, find).groupBy("key").agg(F.min("pos").alias("pos"))

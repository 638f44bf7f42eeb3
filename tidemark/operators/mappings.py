"""Partition mappings between an asset and its upstream, in both directions, and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.partitions import TimeWindow, shift_keys


def pairs_frame(like: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return like.sparkSession.createDataFrame(list(mapping.items()), "key string, upstream string")


def map_identity(keys: DataFrame, universe: DataFrame) -> DataFrame:
    """The same key upstream, where it exists."""
    return keys.join(universe.select("key"), "key", "left_semi").select("key", F.col("key").alias("upstream"))


def map_all(keys: DataFrame, universe: DataFrame) -> DataFrame:
    """Every upstream key for every key. The product is the result asked for; the universe is a definition's."""
    return keys.select("key").crossJoin(universe.select(F.col("key").alias("upstream")))


def map_static(keys: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """By a table of keys; keys not in it map to themselves."""
    table = F.broadcast(pairs_frame(keys, mapping))
    return keys.select("key").join(table, "key", "left").select("key", F.coalesce("upstream", "key").alias("upstream"))


def map_static_down(upstream: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """The keys that a table maps to given upstream keys; upstream keys that are no key of the table pass."""
    table = pairs_frame(upstream, mapping)
    named = upstream.select(F.col("key").alias("upstream")).join(table, "upstream").select("key", "upstream")
    free = upstream.join(table.select("key"), "key", "left_anti").select("key", F.col("key").alias("upstream"))
    return named.unionByName(free).distinct()


def map_window(keys: DataFrame, grid: TimeWindow, offset: int, strict: bool = False) -> DataFrame:
    """``offset`` windows away; keys that leave the grid are dropped, or null with ``strict`` for the caller to reject."""
    moved = shift_keys(keys.select("key"), grid, offset, out="upstream")
    return moved.select("key", "upstream") if strict else moved.filter("upstream IS NOT NULL").select("key", "upstream")


def map_specific(keys: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """A fixed list of upstream keys for every key."""
    return keys.select("key", F.explode(F.array(*(F.lit(c) for c in chosen))).alias("upstream"))


def map_for_keys(keys: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Upstream is loaded for the selected keys only; the others skip it (null)."""
    return keys.select("key", F.when(F.col("key").isin(list(selected)), F.col("key")).alias("upstream"))


def map_subset(keys: DataFrame, universe: DataFrame) -> DataFrame:
    """The same key if it exists upstream, else null: the input is skipped."""
    return keys.select("key").join(universe.select("key", F.col("key").alias("upstream")), "key", "left")


def map_multi(keys: DataFrame, universe: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Per dimension: those named map to an upstream dimension, the upstream's others fan out over its universe."""
    wanted = keys.select("key", *(F.col(a).alias(b) for a, b in renames.items()))
    return wanted.join(universe.withColumnRenamed("key", "upstream"), list(renames.values())).select("key", "upstream")


def map_multi_to_single(keys: DataFrame, dimension: str) -> DataFrame:
    """The value of one dimension is the upstream's key."""
    return keys.select("key", F.col(dimension).alias("upstream"))


def map_single_to_multi(keys: DataFrame, universe: DataFrame, dimension: str) -> DataFrame:
    """A single key stands for every upstream key that has it in one dimension."""
    return keys.select("key").join(universe.select(F.col(dimension).alias("key"), F.col("key").alias("upstream")), "key")


class Selection:
    """A set of partition keys: all, none, or those of a DataFrame with a column ``key``."""

    def __init__(self, universe: DataFrame, keys: DataFrame | None = None, everything: bool = False) -> None:
        self.universe, self.everything = universe.select("key").distinct(), everything
        self._keys = None if keys is None else keys.select("key").distinct()

    def keys(self) -> DataFrame:
        if self.everything:
            return self.universe
        return self.universe.filter(F.lit(False)) if self._keys is None else self._keys

    def _of(self, keys: DataFrame) -> Selection:
        return Selection(self.universe, keys)

    def union(self, other: Selection) -> Selection:
        """All absorbs."""
        return Selection(self.universe, everything=True) if self.everything or other.everything else self._of(self.keys().unionByName(other.keys()))

    def intersect(self, other: Selection) -> Selection:
        """All is the identity."""
        if self.everything or other.everything:
            return other if self.everything else self
        return self._of(self.keys().join(other.keys(), "key", "left_semi"))

    def complement(self) -> Selection:
        return self._of(self.universe.join(self.keys(), "key", "left_anti"))

    def difference(self, other: Selection) -> Selection:
        return self._of(self.keys().join(other.keys(), "key", "left_anti"))

    def restrict(self) -> Selection:
        """Only keys of the universe; all and none stay what they are."""
        return self if self.everything or self._keys is None else self._of(self._keys.join(self.universe, "key", "left_semi"))

    def fires(self) -> DataFrame:
        """One row: whether any key of the universe is selected. All of an empty universe isn't."""
        return self.restrict().keys().agg((F.count(F.lit(1)) > 0).alias("fires"))

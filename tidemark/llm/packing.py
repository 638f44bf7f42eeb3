"""Filling containers of fixed capacity: vector best-fit over classes of equal items.

Items of one size are alike for every constraint, so packing needs only how many items each size
has: a histogram of at most ``capacity`` rows, whatever the number of items. The driver runs vector
best-fit decreasing on these classes, with containers of equal content held as one group with a
multiplicity. The resulting plan (a few runs per size) is then applied to the items by their rank
within their size, in a distributed way. All items are packed together, so nothing is lost at the
borders of partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import cut_lineage, shuffle_width


@dataclass(frozen=True)
class Limits:
    """Capacities of a container and the weights of its residuals in the choice of a container.

    ``attention`` bounds the sum of squared sizes (the cost of attention within items). Without them,
    ``documents`` and ``attention`` bind no sooner than the tokens do, but their residuals still weigh
    in the choice. An item exceeds the capacity if it is above ``piece``, and is then split.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)
    score: str = "norm"

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens * self.tokens

    def piece(self) -> int:
        """The largest size that fits an empty container under every constraint."""
        return min(self.tokens, isqrt(self.vector()[2]))


@dataclass
class Run:
    """``items`` items of one size, ``per`` to a container, in containers first, first + 1, ..."""

    size: int
    first_item: int
    items: int
    first: int
    per: int


def demand(size: int) -> tuple[int, int, int]:
    return size, 1, size * size


def plan(histogram: Mapping[int, int], limits: Limits) -> list[Run]:
    """Vector best-fit decreasing over size classes; the runs that place every item.

    Of the container groups in which an item fits under every constraint, the one with the best
    score is filled first: the least weighted norm of what would be left (``norm``), or the largest
    weighted dot product of demand and residual (``dot``), both relative to the capacities. Only if
    none fits are containers opened. Groups are split only where a class ends, so there are at most
    about two for each class.
    """
    capacity = np.array(limits.vector(), dtype=np.int64)
    if any(size < 1 or size > limits.piece() for size in histogram):
        raise ValueError("an item exceeds the capacity: split it first")
    weights = np.array(limits.weights)
    groups = Groups()
    runs: list[Run] = []
    opened = 0
    for size in sorted(histogram, reverse=True):
        need = np.array(demand(size), dtype=np.int64)
        left_over, placed = histogram[size], 0
        while left_over:
            at = groups.best(need, capacity, weights, limits.score)
            if at is None:
                residual, first, many = capacity, opened, -(-left_over // int((capacity // need).min()))
                opened += many
            else:
                residual, first, many = groups.pop(at)
            per = int((residual // need).min())
            full = min(many, left_over // per)
            for count, items in ((full, per), (min(1, many - full), left_over - full * per if full < many else 0)):
                if count and items:
                    runs.append(Run(size, placed, count * items, first, items))
                    groups.add(residual - items * need, first, count)
                    placed, left_over, first, many = placed + count * items, left_over - count * items, first + count, many - count
            if many:
                groups.add(residual, first, many)
    return runs


class Groups:
    """Open containers of equal content: residual vectors with the first container and the multiplicity of each."""

    def __init__(self) -> None:
        self.residual, self.first, self.many = np.zeros((64, 3), dtype=np.int64), [0] * 64, [0] * 64
        self.size, self.free = 0, list[int]()

    def add(self, residual: np.ndarray, first: int, many: int) -> None:
        """Containers that are full under any constraint take nothing more and aren't kept."""
        if (residual < 1).any():
            return
        at = self.free.pop() if self.free else self.size
        if at == self.size:
            self.size += 1
            if self.size > len(self.first):
                self.residual = np.concatenate([self.residual, np.zeros_like(self.residual)])
                self.first += [0] * len(self.first)
                self.many += [0] * len(self.many)
        self.residual[at], self.first[at], self.many[at] = residual, first, many

    def pop(self, at: int) -> tuple[np.ndarray, int, int]:
        found = self.residual[at].copy(), self.first[at], self.many[at]
        self.residual[at] = 0
        self.free.append(at)
        return found

    def best(self, need: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str) -> int | None:
        """The group that an item suits best among those it fits under every constraint; ties by container."""
        fits = np.flatnonzero((self.residual[: self.size] >= need).all(1))
        if not len(fits):
            return None
        left = self.residual[fits]
        cost = -(left * need / capacity / capacity) @ weights if score == "dot" else (((left - need) / capacity) ** 2) @ weights
        best = fits[cost <= cost.min()]
        return int(min(best, key=lambda i: self.first[i]))


def split_items(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, size): an item above the capacity becomes full pieces and a rest; pieces count from 0.

    Null sizes and sizes below 1 hold nothing and have no piece.
    """
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / capacity).cast("int")))
    return (
        items.filter(F.col(size) >= 1)
        .select(key, F.col(size).alias("__whole"), pieces.alias("piece"))
        .select(key, "piece", F.least(F.col("__whole") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    )


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", limits: Limits | None = None) -> DataFrame:
    """Put items into containers: container, key, piece, size.

    Every item of size 1 or more comes out once, or in pieces if it is above the capacity (``Limits.piece``);
    containers are numbered from 0 without gaps. Null sizes and sizes below 1 hold nothing and have
    no row; rows that repeat a key are items of their own. An empty input gives no rows.

    The rank of an item within its size is found without bringing a size together: local ranks in
    parts chosen by the key's hash, plus the offsets of the parts.
    """
    limits = limits or Limits()
    spark = items.sparkSession
    parts = shuffle_width(spark)
    pieces = split_items(items, key, size, limits.piece()).withColumn("__part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)).cast("int"))
    stored = cut_lineage(pieces)
    by_part = stored.groupBy("size", "__part").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r["size"]: r["n"] for r in by_part.groupBy("size").agg(F.sum("__n").alias("n")).collect()}
    runs = plan(histogram, limits)
    return place(stored, by_part, runs, key, spark)


def place(stored: DataFrame, by_part: DataFrame, runs: Sequence[Run], key: str, spark: SparkSession) -> DataFrame:
    """Give each piece the container that the plan has for its rank within its size."""
    # Sizes x parts rows at most; one task a size takes as many rows as there are parts.
    before = W.partitionBy("size").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_part.select("size", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = F.row_number().over(W.partitionBy("size", "__part").orderBy(key, "piece")) - 1
    ranked = stored.withColumn("__local", local).join(offsets, ["size", "__part"]).withColumn("__rank", F.col("__local") + F.col("__offset"))
    # A few runs for each of at most ``capacity`` sizes: bounded whatever the data.
    table = F.broadcast(
        spark.createDataFrame(
            [(r.size, r.first_item, r.first_item + r.items, r.first, r.per) for r in runs], "size int, __from long, __to long, __first long, __per int"
        )
    )
    here = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    return ranked.join(table, "size").filter(here).select((F.col("__first") + F.floor((F.col("__rank") - F.col("__from")) / F.col("__per"))).alias("container"), key, "piece", "size")

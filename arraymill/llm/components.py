"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dense


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """u, v: for each row one edge a pair of columns, loops left out. As a union would, but in as many partitions."""
    ends = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))
    return rows.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v")


def _smallest(edges: DataFrame) -> DataFrame:
    """For each u the smallest node among u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("u", "v"), ("v", "u"))
    near = both.join(_smallest(both), "u").where("v > u and v <> m")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v"))  # a row an edge at most; repeats go with the small star


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _each(down.join(_smallest(down), "u"), ("v", "m"), ("u", "m")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The component of each node that has an edge.

    Alternating large and small stars: each round moves edges towards the
    smallest node of the component, and the count of rounds grows with the
    logarithm of the longest path. No node's neighbours are ever gathered in
    one place; the minimum is pre-aggregated, and the join back to a node with
    very many neighbours is one that Spark can split. Tables of a few MB are
    read by one task.

    edges: columns u and v, either order, repeats and loops allowed; rows with
    a null end count as no edge. Returns node, component (its smallest node);
    every node other than the smallest of its component has a row.
    """
    now = dense(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        now = dense(_small_star(_large_star(now)))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Connected components of a distributed edge list, by contraction to hashed minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, without nulls). Rows node, root for every node of an edge; equal roots are connected.

    In each round every node moves to the neighbour (or itself) whose hash is least, with another hash each round,
    so about half of the nodes go and chains or stars need a logarithmic number of rounds. Rounds are written tables, whose sizes are
    those of their files: a checkpoint would keep the product of the sizes that were joined, whose digits double from round to round.
    """
    stash, moves = Tables(edges.sparkSession), []
    live = stash.write(edges.select("a", "b").filter("a <> b").distinct(), "live0")
    while not live.isEmpty():
        k = len(moves)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = stash.write(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")), f"move{k}")
        moves.append(move)
        one = live.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        two = one.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        live = stash.write(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"live{k + 1}")
    if not moves:
        stash.remove()
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    root = moves[-1].select("node", F.col("to").alias("root"))
    for k, move in enumerate(reversed(moves[:-1])):
        up = root.select(F.col("node").alias("to"), "root")
        root = stash.write(move.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root")), f"root{k}")
    root = cut(root)
    stash.remove()
    return root

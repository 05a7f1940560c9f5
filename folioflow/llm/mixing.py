"""Mixing sources to target weights, with DataFrame expressions only.

Tokens are summed per source, targets are filled by weight up to a cap, and each document is emitted
floor(rate) times plus one more time if its hash-seeded coin falls under the fraction of the rate.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id takes
the coin of the empty id; rows that repeat are drawn by their doc_id and so alike; an empty table gives no rows;
extra columns pass through, and a clash with an added name is solved by underscores at the added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, sized

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MOST = 3
#: Coins tried for each source; the one whose draw comes nearest the target is used.
SEEDS = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    key = F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """A row for each source: source, source_size, target, rate, seed. Its rows are as many as the sources."""
    each = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))
    sums = each.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sums = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    sums = sums.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    # Sources fill up in order of most/weight: the level of the rest is what the full ones leave, by weight.
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    sums = sums.withColumn("level", level)
    filled = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy())
    sums = sums.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * filled))
    sums = sums.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    sums = cut(sums.select("source", "source_size", "target", "rate"))
    fraction = F.col("rate") - F.floor("rate")
    drawn = each.join(sized(sums, F.length(F.coalesce("source", F.lit(""))) * 4 + 40).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    drawn = drawn.groupBy("s").agg(*[F.sum(F.when(coin(F.col("id"), F.lit(k)) < fraction, F.col("size")).otherwise(F.lit(0))).alias(f"extra{k}") for k in range(seeds)])
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"extra{k}") - F.col("target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]))["seed"]
    done = sums.join(drawn, F.col("source").eqNullSafe(F.col("s"))).withColumn("seed", best)
    return cut(done.select("source", "source_size", "target", "rate", "seed"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with size, source_size, target, copies and taken; its plan is one small row for each source."""
    sources = plan(docs, id_col, text_col, source_col, **how)
    key, names = fresh("source_key", docs.columns), {c: fresh(c, docs.columns) for c in ("size", "source_size", "target", "rate", "seed", "copies", "taken")}
    side = sources.select(F.col("source").alias(key), *[F.col(c).alias(names[c]) for c in ("source_size", "target", "rate", "seed")])
    out = docs.withColumn(names["size"], size_of(F.col(text_col))).join(sized(side, F.length(F.coalesce(F.col(key), F.lit(""))) * 4 + 40), F.col(source_col).eqNullSafe(F.col(key)))
    rate = F.col(names["rate"])
    extra = (coin(F.col(id_col), F.col(names["seed"])) < rate - F.floor(rate)).cast("int")
    out = out.withColumn(names["copies"], F.floor(rate).cast("int") + extra)
    out = out.withColumn(names["taken"], F.col(names["size"]) * F.col(names["copies"]))
    return out.drop(key, names["rate"], names["seed"])


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as often as its copies say, with the columns of docs."""
    mixed = mix(docs, **how)
    copies, n = fresh("copies", docs.columns), fresh("copy", docs.columns)
    return mixed.filter(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)

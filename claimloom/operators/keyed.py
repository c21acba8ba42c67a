"""Keyed building blocks that stay balanced when one key holds much of the data.

* first/last row per key and top-k per key: ``row_number() <= k``.  Spark puts
  a WindowGroupLimit before the shuffle, so each map task forwards at most k
  rows per key, however many rows the key has.
* running numbers and running sums per key: the order column is cut into
  blocks at approximate quantiles; block totals are small and are summed once
  per key, and the window inside a block never sees more than a block's rows.
* sets as digests: hashes are folded by prefix, never gathered in one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.session import cut_lineage


def block_count(spark: SparkSession) -> int:
    """Twice the shuffle parallelism, 64 at least: a cluster that is set up for more rows gets more blocks."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of every key in the given order (first wins)."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                rank: str | None = None) -> DataFrame:
    """Keep the k first rows of every key; ``rank`` names a column for the position."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """A look-up table with one row per key: the first by ``order``, then by all other columns, so ties are settled too."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return first_per_key(df, keys, [*order, *rest])


def split_points(df: DataFrame, order: str, blocks: int | None = None) -> list[float]:
    """Approximate quantiles of a numeric column, one less than there are blocks.

    They steer balance, never results.  Take them from the rawest table that
    has the column: then this is a pruned scan of one column with a map-side
    combine, and nothing expensive is computed twice.
    """
    n = blocks or block_count(df.sparkSession)
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(order).cast("double"), shares, 10 * n).alias("q")).first()
    return sorted({float(p) for p in (row["q"] or []) if p is not None and not math.isnan(p)})


def with_blocks(df: DataFrame, order: str, name: str = "_block", points: Sequence[float] | None = None) -> DataFrame:
    """Number the quantile block of a numeric column; blocks keep its order and equal values share one."""
    found = split_points(df, order) if points is None else list(points)
    if not found:
        return df.withColumn(name, F.lit(0.0))
    cutter = Bucketizer(
        splits=[float("-inf"), *found, float("inf")], inputCol="_order", outputCol=name, handleInvalid="keep"
    )
    return cutter.transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order")


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column],
                 base: DataFrame | None = None, points: Sequence[float] | None = None) -> DataFrame:
    """Running sums per key in the order of a numeric column that is unique within the key.

    ``sums`` maps an output name to the value summed up to and including the
    row.  ``base`` may carry, per key, amounts that come before the key's first
    row (same key and sum names).  ``points`` are the split points of the order
    column when the caller can get them more cheaply than from ``df``.
    """
    values = with_blocks(df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()]), order, points=points)
    totals = values.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    if base is not None:
        start = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(n).alias(f"_s_{n}") for n in sums])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        offsets = offsets.join(start, same, "left").select(
            *keys, "_block",
            *[(F.col(f"_o_{n}") + F.coalesce(F.col(f"_s_{n}"), F.lit(0))).alias(f"_o_{n}") for n in sums],
        )
    offsets = offsets.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *[f"_o_{n}" for n in sums]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = values.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    condition = F.col("_block") == F.col("_k_block")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(offsets, condition, "left")
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """1, 2, 3, ... per key by a numeric column that is unique within the key."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


#: Members of a group of the digest tree, on average at the leaves and at most above them.
DIGEST_GROUP = 256


def digest_width(n: int) -> int:
    """Hex digits of the leaves' prefix: the smallest even number with at most DIGEST_GROUP hashes a prefix on average."""
    width = 0
    while n > DIGEST_GROUP * 16**width:
        width += 2
    return width


def set_digest(df: DataFrame, value: str, width: int | None = None) -> DataFrame:
    """One order-free sha256 over the distinct non-blank hashes of a column.

    The hashes form a tree by their hex prefix: leaves are the groups of one prefix of
    ``digest_width`` digits, which follows the counted number of hashes; above them
    every level drops two digits and has groups of at most 256 digests, up to the
    root.  A group's digest is the sha256 of its members' texts, sorted and joined.
    So no row ever holds more than one small group, whatever the number of hashes.
    The hashes are to be spread evenly over their prefixes, as those of texts are.
    ``width`` fixes the digits of the leaves, for digests that must not change their form
    with the number of hashes; a leaf then has the 16**width-th part of them.
    """
    level = cut_lineage(df.select(F.col(value).alias("_h")).filter(F.coalesce(F.col("_h") != "", F.lit(False))).distinct().select(
        F.col("_h").alias("_p"), F.col("_h").alias("_d"), F.lit(1).cast("bigint").alias("_n")
    ))
    for digits in range(digest_width(level.count()) if width is None else width, -1, -2):
        level = level.groupBy(F.substring("_p", 1, digits).alias("_q")).agg(
            F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_d"))), lambda g: g["_d"]), ""), 256)
            .alias("_d"),
            F.sum("_n").alias("_n"),
        ).withColumnRenamed("_q", "_p")
    return level.select(F.col("_d").alias("digest"), F.col("_n").alias("n_hashes"))


def orphans(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """The distinct keys of ``rows`` that ``known`` does not have; a null key is known to nobody."""
    return rows.select(key).distinct().join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def newest(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of the row with the greatest order value per key (partial aggregation first)."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*keys, "_row.*")


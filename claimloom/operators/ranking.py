"""Ranking metrics without a global sort in one task.

Scores are first reduced to one row per distinct probability (counts of
positives and negatives).  Ranks then come from running sums over blocks of
distinct probabilities; ties never need to be held together in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import keyed


def _by_probability(df: DataFrame, keys: list[str], label: str, probability: str) -> DataFrame:
    return df.filter(F.col(probability).isNotNull()).groupBy(*keys, F.col(probability).alias("_p")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("_pos"),
        F.count("*").alias("_n"),
    )


def auroc(df: DataFrame, label: str, probability: str, keys: list[str] | None = None) -> DataFrame:
    """Rank-sum AUROC with average ties; null when a class is empty."""
    keys = keys or []
    distinct = _by_probability(df, keys, label, probability)
    points = keyed.split_points(df, probability)
    ranked = keyed.running_sums(distinct, keys, "_p", {"_upto": F.col("_n")}, points=points)
    mean_rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum("_pos").alias("positives"),
        F.sum(F.col("_n") - F.col("_pos")).alias("negatives"),
        F.sum(F.col("_pos") * mean_rank).alias("_ranks"),
    )
    pairs = (F.col("positives") * F.col("negatives")).cast("double")
    lowest = F.col("positives") * (F.col("positives") + 1) / 2.0
    return sums.select(
        *keys, "positives", "negatives",
        F.when(pairs > 0, (F.col("_ranks") - lowest) / pairs).alias("auroc"),
    )


def positions(df: DataFrame, label: str, probability: str, tie: str, keys: list[str] | None = None) -> DataFrame:
    """Each scored row with its position and the positives up to it, by probability descending and then ``tie``.

    Rows are counted inside (probability, tie block), so even one probability
    shared by a third of all rows is spread over many tasks.
    """
    keys = keys or []
    names = {"position": F.lit(1).cast("bigint"), "positives_so_far": (F.col(label) == 1).cast("bigint")}
    scored = df.filter(F.col(probability).isNotNull()).withColumn("_d", -F.col(probability))
    distinct = _by_probability(scored, keys, label, "_d")
    points = keyed.split_points(scored, "_d")
    upto = keyed.running_sums(distinct, keys, "_p", {"_cn": F.col("_n"), "_cp": F.col("_pos")}, points=points)
    base = upto.select(
        *keys,
        F.col("_p").alias("_d"),
        (F.col("_cn") - F.col("_n")).alias("position"),
        (F.col("_cp") - F.col("_pos")).alias("positives_so_far"),
    )
    return keyed.running_sums(scored, [*keys, "_d"], tie, names, base=base).drop("_d")


def average_precision(df: DataFrame, label: str, probability: str, tie: str, keys: list[str] | None = None) -> DataFrame:
    """Mean precision at the positives; null when there is none."""
    keys = keys or []
    rows = positions(df, label, probability, tie, keys)
    precision = F.col("positives_so_far") / F.col("position")
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col(label) == 1, precision)).alias("average_precision"))


def average_rank(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """rank(ties = average) of every row, ascending."""
    keys = keys or []
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_p")).agg(
        F.count("*").alias("_n")
    )
    points = keyed.split_points(df, value)
    ranked = keyed.running_sums(distinct, keys, "_p", {"_upto": F.col("_n")}, points=points).select(
        *[F.col(k).alias(f"_j_{k}") for k in keys],
        "_p",
        (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias("average_rank"),
    )
    condition = F.col(value) == F.col("_p")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return df.join(ranked, condition, "left").select(*df.columns, "average_rank")


def group_positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """First position of each group and its dense number in first-seen order (numeric unique order column)."""
    firsts = df.groupBy(group).agg(F.min(order).alias("first_position"))
    return keyed.running_sums(firsts, [], "first_position", {"group_number": F.lit(1).cast("bigint")},
                              points=keyed.split_points(df, order))



def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per key with linear interpolation (type 7), one output column per name.

    Values are counted, ranked by running sums over blocks, and only the rows
    that hold a wanted rank are read; no group is gathered or sorted in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(
        F.count("*").alias("_n")
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total")).select(
        *[F.col(k).alias(f"_j_{k}") for k in keys], "_total"
    )
    points = keyed.split_points(df, value)
    ranked = keyed.running_sums(counts, keys, "_x", {"_upto": F.col("_n")}, points=points)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    rows = ranked.join(totals, condition)

    def at(rank):
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_x")))

    picks = [F.first("_total").alias("n")]
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(p) + 1
        picks += [
            at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}"),
            F.first(position - F.floor(position)).alias(f"_part_{name}"),
        ]
    found = rows.groupBy(*keys).agg(*picks)
    return found.select(*keys, "n", *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
        for n in probabilities
    ])

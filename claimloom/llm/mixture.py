"""Mixing sources by temperature, realised as budgeted block permutations.

A source with share p of all tokens gets weight p**t / sum of p**t.  The exponent
t is bisected until the weights have a wanted entropy, or until no source repeats
more often than a limit; six halvings are evaluated in one job over the table of
sources, and only these 63 sums reach the driver.  Each source then runs through
permuted blocks of its documents, epoch after epoch, until its token budget is
used up; within a block the documents are permuted too.

Budgets: with ``budget`` the weights share out that many tokens.  Without it the
budget is the smallest one under which no source is cut: the most reduced source
is taken exactly once, every other source repeats.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from claimloom.session import cut_lineage, scratch_path

BLOCK_TOKENS = 65536
HALVINGS = 6
PASSES = 8
SEED = 17
MIX_COLUMNS = ["mix_epoch", "mix_block", "mix_position", "mix_place"]


def token_count(text: Column) -> Column:
    """White-space separated words; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens, documents, share); sources without tokens have share 0, a null source is a source."""
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(token_count(F.col(text))).alias("tokens"), F.count("*").alias("documents"))
    sums = cut_lineage(sums)
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0)
    return sums.select("source", "tokens", "documents", share.alias("share"), F.lit(total).cast("long").alias("total"))


def _judged(shares: DataFrame, exponents: list[float], budget: float | None) -> list:
    """Entropy of the weights and the most repeats, for each exponent."""
    t, p = F.col("t"), F.col("share")
    tried = shares.where("share > 0").select("share", "total", F.explode(F.array(*map(F.lit, exponents))).alias("t"))
    sums = tried.groupBy("t").agg(
        F.sum(F.pow(p, t)).alias("z"), F.sum(F.pow(p, t) * F.log(p)).alias("zl"), F.max(F.pow(p, t - 1)).alias("most"),
        F.min(F.pow(p, t - 1)).alias("least"), F.max("total").alias("total"))
    repeats = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * F.lit(float(budget)) / F.col("total")
    return sums.select("t", (F.log("z") - t * F.col("zl") / F.col("z")).alias("entropy"), repeats.alias("repeats")).orderBy("t").collect()


def exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None,
             high: float = 1.0) -> float:
    """The smallest exponent in 0..high under which entropy and repeats are within their limits.

    Both fall as the exponent rises, so a limit that is not binding gives 0
    (equal weights) and one that cannot be met gives ``high``.
    """
    low, n = 0.0, 1 << HALVINGS

    def fits(row) -> bool:
        return (entropy is None or row["entropy"] <= entropy) and (max_repeats is None or row["repeats"] <= max_repeats)

    start = _judged(shares, [0.0], budget)
    if not start or fits(start[0]):
        return 0.0
    for _ in range(PASSES):
        step = (high - low) / n
        inner = _judged(shares, [low + step * k for k in range(1, n)], budget)
        first = next((k for k, row in enumerate(inner, 1) if fits(row)), n)
        low, high = low + step * (first - 1), low + step * first
    return round(high, 12)


def budgets(shares: DataFrame, t: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, documents, weight, budget, repeats, whole, rest): whole epochs and the tokens of the last, partial one."""
    sums = shares.where("share > 0").agg(
        F.sum(F.pow("share", F.lit(t))).alias("z"), F.min(F.pow("share", F.lit(t - 1.0))).alias("least"), F.max("total").alias("total")).first()
    z = sums["z"] or 1.0  # no source has tokens: no weights
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(t)) / F.lit(z)).otherwise(0.0)
    whole_budget = F.lit((sums["total"] or 0) * z / (sums["least"] or 1.0) if budget is None else float(budget))
    # Rounded to whole tokens, and a source that is within a token of whole epochs is taken whole.
    planned = shares.select("source", "tokens", "documents", weight.alias("weight"), F.coalesce(F.round(weight * whole_budget), F.lit(0)).cast("long").alias("budget"))
    whole = F.when(F.col("tokens") > 0, F.floor((F.col("budget") + 1) / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    return planned.select("*", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(0.0).alias("repeats"), whole.alias("whole"),
                          F.greatest(F.col("budget") - whole * F.col("tokens"), F.lit(0)).alias("rest"))


def _block(doc: Column, text: Column, tokens: Column) -> Column:
    return F.pmod(F.xxhash64(doc, text), F.greatest(F.ceil(tokens / BLOCK_TOKENS), F.lit(1)).cast("long"))


def block_starts(docs: DataFrame, plan: DataFrame, doc: str, text: str, source: str, seed: int = SEED) -> DataFrame:
    """(source, epoch, block, start, block_tokens): where each permuted block begins among the source's tokens.

    Running sums are taken in two steps, over runs of about the square root of
    a source's number of blocks, so no window holds all blocks of a hot source.
    """
    slim = docs.select(F.col(doc).alias("d"), F.col(text).alias("x"), F.col(source).alias("s")).join(plan, F.col("s").eqNullSafe(F.col("source")))
    sums = cut_lineage(slim.groupBy("source", _block(F.col("d"), F.col("x"), F.col("tokens")).alias("block")).agg(F.sum(token_count(F.col("x"))).alias("block_tokens")))
    blocks = sums.join(plan.select(F.col("source").alias("s"), "tokens", "whole", "rest"), sums["source"].eqNullSafe(F.col("s")))
    epochs = blocks.select("source", "block", "block_tokens", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"), "whole", "rest").where("epoch < whole OR rest > 0")
    key = F.pmod(F.xxhash64(F.lit(seed), "source", "block", "epoch"), F.lit(1 << 40))
    runs = F.greatest(F.ceil(F.sqrt(F.col("tokens") / BLOCK_TOKENS)), F.lit(1)).cast("long")
    keyed = epochs.withColumn("key", key).withColumn("run", F.floor(F.col("key") * runs / F.lit(1 << 40)))
    of_run = keyed.groupBy("source", "epoch", "run").agg(F.sum("block_tokens").alias("run_tokens"))
    of_run = of_run.select(F.col("source").alias("rs"), F.col("epoch").alias("re"), F.col("run").alias("rr"),
                           F.expr("sum(run_tokens) OVER (PARTITION BY source, epoch ORDER BY run) - run_tokens").alias("before"))
    inside = F.expr("sum(block_tokens) OVER (PARTITION BY source, epoch, run ORDER BY key, block) - block_tokens")
    placed = keyed.withColumn("inside", inside).join(of_run, F.col("source").eqNullSafe(F.col("rs")) & (F.col("epoch") == F.col("re")) & (F.col("run") == F.col("rr")))
    return placed.select("source", "epoch", "block", (F.col("before") + F.col("inside")).alias("start"), "block_tokens", "whole", "rest", "tokens")


def realise(docs: DataFrame, plan: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED,
            ordered: bool = True) -> DataFrame:
    """Every copy of every document that the plan takes, with all columns and ``mix_epoch``, ``mix_block``.

    With ``ordered`` there are also ``mix_position``, where in 0..1 of its
    source's budget the block begins (sorting blocks of all sources by it mixes
    them at their weights), and ``mix_place``, the rank inside the block.
    The partial epoch takes whole blocks and, of the block in which the budget
    ends, the documents that begin before the end; it overshoots by less than a
    document.  Whole epochs take every row, documents without tokens included;
    a source without any tokens is taken once.  Input columns that are named like
    one of the four are replaced.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "mixture")
    plan.write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan").withColumn("whole", F.when(F.col("tokens") > 0, F.col("whole")).otherwise(F.lit(1)))
    block_starts(docs, plan, doc, text, source, seed).write.parquet(f"{folder}/blocks")
    starts = spark.read.parquet(f"{folder}/blocks").where("epoch < whole OR start < rest")
    starts = starts.select(F.col("source").alias("_s"), F.col("epoch").alias("mix_epoch"), F.col("block").alias("_b"), "start", "block_tokens", "rest",
                           (F.col("epoch") < F.col("whole")).alias("_whole"),
                           ((F.col("epoch") * F.col("tokens") + F.col("start")) / F.greatest(F.col("whole") * F.col("tokens") + F.col("rest"), F.lit(1))).alias("mix_position"))
    # The row goes along as one value, so its column names meet no others.
    names = [c for c in docs.columns if c not in MIX_COLUMNS]
    own = docs.select(F.struct(*names).alias("_row"), F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    sized = plan.select(F.col("source").alias("_ps"), F.col("tokens").alias("_tokens"))
    rows = own.join(sized, F.col("_source").eqNullSafe(F.col("_ps"))).withColumn("mix_block", _block(F.col("_doc"), F.col("_text"), F.col("_tokens")))
    taken = rows.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("mix_block") == F.col("_b"))).withColumn(
        "_order", F.xxhash64(F.lit(seed), "mix_epoch", "_doc", "_text"))
    whole_block = F.col("_whole") | (F.col("start") + F.col("block_tokens") <= F.col("rest"))
    # Only the block that holds the end of a budget is cut; a source has one such block at most.
    tokens = token_count(F.col("_text"))
    cut = taken.where(~whole_block).withColumn("_before", F.sum(tokens).over(_window("_s", "mix_epoch", "mix_block")) - tokens)
    columns = ["_row", "_s", "_order", "mix_epoch", "mix_block", "mix_position"]
    result = taken.where(whole_block).select(*columns).unionByName(cut.where("start + _before < rest").select(*columns))
    if not ordered:
        return result.select("_row.*", "mix_epoch", "mix_block")
    return result.withColumn("mix_place", F.row_number().over(_window("_s", "mix_epoch", "mix_block"))).select("_row.*", *MIX_COLUMNS)


def _window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)


def mixed(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", entropy: float | None = None,
          max_repeats: float | None = None, budget: float | None = None, seed: int = SEED, ordered: bool = True) -> DataFrame:
    """Shares, exponent, budgets and their realisation in one call.

    A null source is a source of its own; null and empty texts have no tokens.
    Equal rows are dealt alike.  An empty table gives no rows.
    """
    shares = cut_lineage(source_shares(docs, source, text))
    t = exponent(shares, entropy, max_repeats, budget)
    return realise(docs, budgets(shares, t, budget), doc, text, source, seed, ordered)


def max_entropy(n_sources: int) -> float:
    """Entropy of equal weights, the upper end of what ``entropy`` can ask for."""
    return math.log(n_sources)

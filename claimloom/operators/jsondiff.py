"""Leaf-level differences between two tables of JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import jsontools as J
from claimloom.functions import numbers as N
from claimloom.functions import text as X

MISSING = "—"


def leaf_rows(df: DataFrame, keys: Sequence[str], json_col: str, levels: int = 8) -> DataFrame:
    """(keys, pointer, label, kind, text, number, json): one row per leaf, exploded inside the task.

    The leaf is split into plain columns here, once, so that the join moves no
    VARIANT and the comparison runs on primitive values.
    """
    rows = J.with_leaves(df.select(*keys, F.col(json_col).alias("_json")), "_json", "_leaves", levels)
    rows = X.inline_rows(rows, keys, "_leaves", "pointer")
    kinds = rows.select(*keys, "pointer", "label", "node", J.kind_of(F.col("node")).alias("kind"))
    return kinds.select(
        *keys, "pointer", "label", "kind",
        F.when(F.col("kind") == "string", J.text_of(F.col("node"))).alias("text"),
        F.when(F.col("kind") == "number", F.try_variant_get("node", "$", "double")).alias("number"),
        F.to_json("node").alias("json"),
    )


def diff_leaves(reference: DataFrame, prediction: DataFrame, keys: Sequence[str],
                relative: float = config.RELATIVE_TOLERANCE, absolute: float = config.ABSOLUTE_TOLERANCE) -> DataFrame:
    """Full outer join of leaves on (keys, pointer), with a status, display values and the percent delta."""
    fields = ("label", "kind", "text", "number", "json")
    left = reference.select(*keys, "pointer", *[F.col(f).alias(f"{f}_l") for f in fields])
    right = prediction.select(*keys, "pointer", *[F.col(f).alias(f"{f}_r") for f in fields])
    both = left.join(right, [*keys, "pointer"], "full_outer")
    in_l, in_r = F.col("kind_l").isNotNull(), F.col("kind_r").isNotNull()
    kinds = (F.col("kind_l"), F.col("kind_r"))
    same_kind = kinds[0] == kinds[1]
    equal = (
        F.when(~same_kind, F.lit(False))
        .when(kinds[0] == "number", N.numeric_close(F.col("number_l"), F.col("number_r"), relative, absolute))
        .when((kinds[0] == "string") & (F.col("pointer") == "/compound"),
              X.compound_code("text_l") == X.compound_code("text_r"))
        .when(kinds[0] == "string", (F.col("text_l") == F.col("text_r")) | (X.normalise("text_l") == X.normalise("text_r")))
        .otherwise(F.col("json_l") == F.col("json_r"))
    )
    status = (
        F.when(~in_l, F.lit("prediction only")).when(~in_r, F.lit("reference only"))
        .when(equal, F.lit("Match")).otherwise(F.lit("Different"))
    )

    def shown(side: str) -> Column:
        return F.when(F.col(f"kind_{side}").isNull(), F.lit(MISSING)).otherwise(
            X.display_value(F.coalesce(F.col(f"text_{side}"), F.col(f"json_{side}")))
        )

    return both.select(
        *keys,
        "pointer",
        F.coalesce("label_l", "label_r").alias("field"),
        shown("l").alias("reference_value"),
        shown("r").alias("prediction_value"),
        N.percent_delta(F.col("number_l"), F.col("number_r")).alias("delta_percent"),
        status.alias("status"),
        F.col("json_l").alias("reference_json"),
        F.col("json_r").alias("prediction_json"),
    )


def status_order(status: Column) -> Column:
    return F.array_position(F.lit(config.DIFF_STATUSES), status)


def choose_variant(variants: Column, prediction: Column, variant: str) -> Column:
    """The stored variant by name; the primary prediction otherwise.  An unknown name is an error when variants exist."""
    if variant == "prediction":
        return prediction
    known = F.map_contains_key(variants, F.lit(variant))
    return F.when(known | (F.size(variants) == 0), F.try_element_at(variants, F.lit(variant))).otherwise(
        F.raise_error(F.lit(f"prediction variant not found: {variant}")).cast("string")
    )


def compare_documents(reference: DataFrame, predictions: DataFrame, keys: Sequence[str], reference_json: str,
                      prediction_json: str, relative: float = config.RELATIVE_TOLERANCE,
                      absolute: float = config.ABSOLUTE_TOLERANCE, levels: int = 8) -> DataFrame:
    """Differences for every reference document; a missing prediction leaves all leaves 'reference only'."""
    known = predictions.join(reference.select(*keys), list(keys), "left_semi")
    return diff_leaves(
        leaf_rows(reference, keys, reference_json, levels), leaf_rows(known, keys, prediction_json, levels), keys,
        relative, absolute,
    )


def status_tally(diff: DataFrame) -> DataFrame:
    """Counts per status, with zero for the statuses that do not occur."""
    total = [F.count_if(F.col("status") == s).alias(f"n{i}") for i, s in enumerate(config.DIFF_STATUSES)]
    one = diff.agg(*total)
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"n{i}").alias("n"))
                      for i, s in enumerate(config.DIFF_STATUSES)])
    return one.select(F.inline(pairs))

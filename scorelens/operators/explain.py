"""Named model weights, highest and lowest first."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = 10
WEIGHT_SCHEMA = "side string, slot int, feature string, weight double"


def ranked_weights(weights: Sequence[float], names: Sequence[str], k: int = TOP) -> list[tuple]:
    """(side, slot, feature, weight) of the k largest and the k smallest weights, ties in slot order.

    A fitted model's weights are an array of the driver; only the rows that are
    shown become rows. Slots without a name get their number.
    """
    weights = np.asarray(weights, "double")
    rows = []
    for side, order in (("top", np.argsort(-weights, kind="stable")), ("bottom", np.argsort(weights, kind="stable"))):
        for slot in order[:k].tolist():
            rows.append((side, slot, names[slot] if slot < len(names) else f"Feature {slot}", float(weights[slot])))
    return rows


def ranked_slots(weights: DataFrame, k: int = TOP) -> list[tuple]:
    """(side, slot, weight), as `ranked_weights` has them, of a table (slot, weight) of any size."""
    rows = []
    for side, order in (("top", F.desc("weight")), ("bottom", F.asc("weight"))):
        rows += [(side, row["slot"], row["weight"]) for row in weights.orderBy(order, "slot").limit(k).collect()]
    return rows


def explain_weights(spark: SparkSession, weights: Sequence[float], names: Sequence[str], k: int = TOP) -> DataFrame:
    return spark.createDataFrame(ranked_weights(weights, names, k), WEIGHT_SCHEMA)

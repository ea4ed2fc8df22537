"""Agreement between label sensors and validation of a model on satellite labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import scalars as S
from hydrolens.operators.aggregates import ratio
from hydrolens.operators.joins import pair_labels
from hydrolens.plans import metrics as M
from hydrolens.plans.training import score
from hydrolens.session import materialize

_PAIR = ["reference_event_id", "sar_event_id"]


def agreement_pairs(gfd: DataFrame, sar: DataFrame, mapping: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells labelled by both sensors; inputs hold (event_id, key, flooded_fraction, target_label)."""
    pairs = pair_labels(gfd, sar, mapping, key)
    return pairs.withColumns(
        {
            "fraction_delta": F.abs(F.col("gfd_flooded_fraction") - F.col("sar_flooded_fraction")),
            "label_match": (F.col("gfd_target_label") == F.col("sar_target_label")).cast("int"),
        }
    )


def summarize_agreement(pairs: DataFrame, keys=tuple(_PAIR)) -> DataFrame:
    """Per event pair: cells, mean fraction delta, agreement rate, intersection over union, positives."""
    g, s = F.col("gfd_target_label"), F.col("sar_target_label")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared_cells"),
        F.avg("fraction_delta").alias("mean_fraction_delta"),
        F.avg("label_match").alias("label_agreement_rate"),
        ratio(F.sum(g * s), F.sum(F.greatest(g, s))).alias("binary_iou"),
        F.sum(g).cast("bigint").alias("gfd_positive_cells"),
        F.sum(s).cast("bigint").alias("sar_positive_cells"),
    )


def balanced_threshold(artifact: dict) -> float:
    value = artifact.get("metrics", {}).get("threshold_profiles", {}).get("balanced", {}).get("threshold")
    return float(value) if isinstance(value, (int, float)) else float(artifact.get("decision_threshold") or 0.5)


def sar_validation(gfd: DataFrame, sar: DataFrame, mapping: DataFrame, artifact: dict, key: str = "cell_id") -> dict:
    """(status, per-pair report, overall report).

    Probabilities are not tempered. Pair metrics read the shared cells, the overall metrics read every satellite
    cell of a paired event. Without satellite rows the status is ``awaiting_sar_labels`` and the frames are empty.
    """
    threshold = balanced_threshold(artifact)
    # both reports read the labels, so these are made, scored and paired once
    sar = materialize(sar)
    pairs = materialize(agreement_pairs(
        gfd.select("event_id", key, "flooded_fraction", "target_label"), sar.select("event_id", key, "flooded_fraction", "target_label"), mapping, key
    ))
    scored = score(sar, artifact).select(
        F.col("event_id").alias("sar_event_id"), key, F.col("target_label").alias("label"), "probability",
        F.concat_ws(":", "event_id", F.col(key).cast("string")).alias("row_key"),
    )
    shared = scored.join(pairs.select(*_PAIR, key), ["sar_event_id", key])
    per_pair = summarize_agreement(pairs).join(M.evaluate(shared, _PAIR, threshold), _PAIR)
    paired = pairs.select("sar_event_id").distinct()
    overall = M.evaluate(scored.join(paired, "sar_event_id", "left_semi"), [], threshold)
    status = "awaiting_sar_labels" if sar.limit(1).count() == 0 else "complete"
    return {"status": status, "decision_threshold": threshold, "pairs": per_pair, "overall": overall}


def label_rows(dataset: DataFrame, threshold: float, mode: str, key: str = "cell_id") -> DataFrame:
    return dataset.withColumn("target_label", S.target_label(threshold, mode)).select("event_id", key, "flooded_fraction", "target_label")

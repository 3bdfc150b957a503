"""The measured numbers turned into a recommendation, as column expressions for many candidates at once.

Inputs are columns; null means not measurable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: band edges, width of a borderline, and floors of gain, tail gap and score shift
BANDS = ((0.95, "bridge_sufficient"), (0.85, "bridge_and_migrate"), (0.70, "caution"))
BORDER, GAIN_FLOOR, TAIL_GAP, SHIFT, UNSETTLED = 0.025, 1.02, 0.1, 0.1, 0.22
NONE_NEEDED, REINDEX = "no_upgrade_needed", "full_reindex"


def band(arr: Column) -> Column:
    """Band of a retained share of recall."""
    out = F.lit(REINDEX)
    for edge, name in reversed(BANDS):
        out = F.when(arr >= edge, name).otherwise(out)
    return out


def decided(rows: DataFrame) -> DataFrame:
    """``rows`` with decision, provisional, borderline, arrangement and warnings.

    Needs columns arr, ci_low, ci_high, gain, shift, tail, old_arr, tier, uninformative,
    ndcg_gain, cascade_arr, reuse, rows and can_read_text. Settled early: no gain, or a
    bridge that loses more than the borderline against the old model. Then the band,
    which a bridge that beats the old model raises.
    """
    c = {n: F.col(n) for n in ("arr", "ci_low", "ci_high", "gain", "shift", "tail", "old_arr", "ndcg_gain", "cascade_arr", "reuse")}
    flat = F.coalesce(F.col("uninformative"), F.lit(False))
    unsettled = (F.col("tier") == "t2") & (F.abs(c["gain"] - 1) <= UNSETTLED)
    no_gain = F.coalesce(c["gain"] < GAIN_FLOOR, F.lit(False))
    loses = F.coalesce(c["old_arr"] - c["arr"] > BORDER, F.lit(False))
    early = no_gain | loses
    advantage = F.when(~flat, c["arr"] * c["gain"])
    beats = F.coalesce(advantage > 1 + BORDER, F.lit(False)) & ~early
    even = F.coalesce(F.abs(advantage - 1) <= BORDER, F.lit(False)) & ~early
    raised = F.when(c["arr"] >= BANDS[0][0], BANDS[0][1]).otherwise(BANDS[1][1])
    decision = F.when(no_gain, NONE_NEEDED).when(loses, F.when(F.coalesce(c["gain"] >= GAIN_FLOOR, F.lit(False)), REINDEX).otherwise(NONE_NEEDED)).when(beats, raised).otherwise(band(c["arr"]))
    edges = [edge for edge, _ in BANDS]
    distance = F.least(*[F.abs(c["arr"] - e) for e in edges])
    straddles = F.coalesce(F.greatest(*[((c["ci_low"] < e) & (c["ci_high"] >= e)).cast("int") for e in edges]) == 1, F.lit(False))
    late = ~early
    warn = F.array_compact(
        F.array(
            F.when(late & straddles, "interval_spans_a_band"),
            F.when(late & ~straddles & (distance <= BORDER), "borderline"),
            F.when(even, "within_noise_of_old_model"),
            F.when(late & (c["shift"] > SHIFT), "score_shift"),
            F.when(late & (c["old_arr"] > c["arr"]), "small_loss"),
            F.when(late & (c["arr"] - c["tail"] > TAIL_GAP), "weak_tail"),
            F.when(late & ((advantage - 1) * (c["ndcg_gain"] - 1) < 0), "metrics_disagree"),
        )
    )
    two_stage = F.coalesce(c["cascade_arr"] * c["gain"] > 1 + BORDER, F.lit(False)) & ~F.coalesce(c["arr"] * c["gain"] > 1 + BORDER, F.lit(False))
    able = F.coalesce(F.col("can_read_text"), F.lit(False)) & c["reuse"].isNotNull()
    return rows.withColumns(
        {
            "decision": decision,
            "provisional": c["gain"].isNull() | flat | F.coalesce(unsettled, F.lit(False)) | even,
            "borderline": F.coalesce(late & (distance <= BORDER), F.lit(False)),
            "arrangement": F.when(two_stage & able, "cascade").otherwise("single_stage"),
            "warnings": warn,
            "encodings_per_query": F.when(two_stage & able, F.col("rows") * (1 - c["reuse"])),
        }
    )


def survivors(candidates: DataFrame, margin: float = BORDER) -> DataFrame:
    """Candidates within ``margin`` of the best gain; one without a gain stays only if none has one."""
    top = candidates.agg(F.max("gain").alias("_top"))
    return candidates.crossJoin(F.broadcast(top)).where((F.col("gain") >= F.col("_top") - margin) | F.col("_top").isNull()).drop("_top")  # one row


def ordered(candidates: DataFrame) -> DataFrame:
    """Best gain first, those without a gain last, ties by name."""
    return candidates.orderBy(F.col("gain").desc_nulls_last(), "name")

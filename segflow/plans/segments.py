"""From speaker turns and speech regions to classified segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.functions.samples import best_class
from segflow.operators.intervals import merge_close, overlap_join, sliding_windows, valid_intervals
from segflow.operators.reshape import min_duration


def speech_turns(turns: DataFrame, regions: DataFrame, recording: str, speaker: list[str], least: float = 0.2, gap: float = 0.5, shortest: float = 0.2) -> DataFrame:
    """Turns cut to speech, joined where a speaker goes on within ``gap`` seconds, short ones left out."""
    inside = overlap_join(valid_intervals(turns), valid_intervals(regions), [recording], least)
    return min_duration(merge_close(inside, [recording, *speaker], gap), shortest)


def score_windows(segments: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], classes: list[str], ids: list[str], window: float = 1.0, hop: float = 0.5) -> DataFrame:
    """Class probabilities of segments: their windows' ones, weighted, from any model.

    ``predict`` maps a frame of windows to a frame of one column for each
    class; it runs on Arrow batches in the tasks.
    """
    windows = sliding_windows(segments, window, hop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[[*ids, "weight"]].reset_index(drop=True), predict(pdf)[classes].reset_index(drop=True)], axis=1)

    kinds = ", ".join(f"`{i}` {segments.schema[i].dataType.simpleString()}" for i in ids)
    scored = windows.mapInPandas(run, f"{kinds}, weight double, " + ", ".join(f"`{c}` double" for c in classes))
    means = scored.groupBy(*ids).agg(F.count("*").alias("n_windows"), *[(F.sum(F.col(c) * F.col("weight")) / (F.sum("weight") + 1e-12)).alias(f"probs_{c}") for c in classes])
    name, confidence = best_class({c: F.col(f"probs_{c}") for c in classes})
    return segments.join(means.withColumns({"predicted_class": name, "predicted_confidence": confidence}), ids, "left")


def class_balance(segments: DataFrame, label: str, duration: str) -> DataFrame:
    """Share of rows and time of each class."""
    counts = segments.groupBy(label).agg(F.count("*").alias("n"), F.sum(duration).alias("sec"))
    whole = Window.partitionBy()  # a row for each class
    return counts.withColumn("share_n", F.col("n") / F.sum("n").over(whole)).withColumn("share_sec", F.col("sec") / F.sum("sec").over(whole))

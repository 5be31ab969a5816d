"""How well predictions agree with corrected notes: from folders of files, or tables, to scores per song and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from ..sources import media


def scored(truth: DataFrame, pred: DataFrame, keys: list[str], tolerance: float = 0.1, total: str = "all") -> DataFrame:
    """Each song's counts and shares and those over all songs, whose counts are summed before they are divided."""
    return matching.scores(matching.joined_notes(truth, pred, keys, tolerance), keys, total)


def scored_folders(spark: SparkSession, folder: str) -> DataFrame:
    """``scored`` for the songs (subfolders) that have both a truth.json and a predicted.json. A song whose truth lists
    no notes has no row."""
    truth, pred = media.read_truth(spark, f"{folder}/*/truth.json"), media.read_predictions(spark, f"{folder}/*/predicted.json")
    both = spark.read.format("binaryFile").load(f"{folder}/*/predicted.json").select(F.element_at(F.split("path", "/"), -2).alias("song")).distinct()
    return scored(truth.join(both, "song", "left_semi"), pred, ["song"])


def truth_template(predictions: DataFrame) -> DataFrame:
    """Predicted notes (song, pos, pitch, onset_sec, hand, finger) as notes to correct, in order of onset, renumbered."""
    from pyspark.sql import Window

    order = Window.partitionBy("song").orderBy("onset_sec", "pos")
    return predictions.where("onset_sec IS NOT NULL AND hand IS NOT NULL").withColumn("pos", F.row_number().over(order) - 1)

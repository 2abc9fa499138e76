"""Metrics over time windows of a stream: the groups' sums per window are all that is kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_group_sums(stream: DataFrame, ts: str, group: str, y_pred: str, y_true: str | None = None, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, grp, n, s, n_pos, s_pos, n_neg, s_neg); rows later than the watermark are left out."""
    yt = F.col(y_true).cast("double") if y_true else F.lit(None).cast("double")
    # a watermark needs a timestamp with zone
    r = stream.select(F.col(ts).cast("timestamp").alias("at__"), F.col(group).cast("string").alias("grp"), F.col(y_pred).cast("double").alias("p"), yt.alias("t"))
    r = r.withWatermark("at__", late).where("grp is not null and p is not null")
    at = F.window("at__", width, slide) if slide else F.window("at__", width)
    sums = [F.count("*").alias("n"), F.sum("p").alias("s")]
    for v, k in ((1, "pos"), (0, "neg")):
        sums += [F.count(F.when(F.col("t") == v, 1)).alias(f"n_{k}"), F.sum(F.when(F.col("t") == v, F.col("p"))).alias(f"s_{k}")]
    return r.groupBy(at.alias("w"), "grp").agg(*sums).select(F.col("w.start").alias("window_start"), "grp", "n", "s", "n_pos", "s_pos", "n_neg", "s_neg")


def gaps(sums: DataFrame, min_group_size: int = 30) -> DataFrame:
    """(window_start, dpd, eod, n_groups) of windowed_group_sums, in batch or in foreachBatch."""
    r = sums.where(F.col("n") >= min_group_size).select("window_start", (F.col("s") / F.col("n")).alias("rate"), F.try_divide("s_pos", "n_pos").alias("tpr"), F.try_divide("s_neg", "n_neg").alias("fpr"))
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    return r.groupBy("window_start").agg(gap("rate").alias("dpd"), F.greatest(gap("tpr"), gap("fpr")).alias("eod"), F.count("*").alias("n_groups"))


def monitor(stream: DataFrame, ts: str, group: str, y_pred: str, path: str, checkpoint: str, y_true: str | None = None, width: str = "1 hour", late: str = "10 minutes", min_group_size: int = 30, **trigger):
    """Writes the gaps of each window that closed to Parquet below path, a folder for each batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        gaps(batch, min_group_size).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    s = windowed_group_sums(stream, ts, group, y_pred, y_true, width, None, late)
    return s.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()

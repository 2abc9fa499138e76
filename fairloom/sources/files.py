"""Reading and writing tables and small texts, and the synthetic inputs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header, JSON lines, ORC or Parquet by the path's ending; NaN in floating columns becomes NULL. Give CSV a schema for large inputs."""
    kind = Path(path.rstrip("/")).suffix.lower().lstrip(".")
    if kind in ("csv", "tsv"):
        r = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        r = r.schema(schema) if schema else r.option("inferSchema", True)
        return nan_to_null(r.csv(path))
    r = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(getattr(r, {"json": "json", "jsonl": "json", "orc": "orc"}.get(kind, "parquet"))(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in cols}) if cols else df


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """By the path's ending, as a folder; single_file only for small results."""
    kind = Path(path.rstrip("/")).suffix.lower().lstrip(".")
    w = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path) if kind in ("json", "jsonl") else w.orc(path) if kind == "orc" else w.parquet(path)


def write_text(path: str, text: str) -> None:
    """A small report on the driver's file system; folders are made."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def dev_sample(spark: SparkSession, n: int = 200, seed: int = 7) -> DataFrame:
    """Labels, predictions and scores of three groups."""
    u = lambda i: F.rand(seed + i)
    g = F.when(F.col("u") < 0.5, "A").when(F.col("u") < 0.8, "B").otherwise("C")
    d = spark.range(n).withColumn("u", u(0)).withColumn("sensitive", g).withColumn("score", u(1))
    d = d.withColumn("y_pred", (F.col("score") >= F.when(F.col("sensitive") == "C", 0.7).otherwise(0.5)).cast("int"))
    return d.select((u(2) < 0.3 + 0.4 * F.col("score")).cast("int").alias("y_true"), "y_pred", "sensitive", "score")


def train_sample(spark: SparkSession, n: int = 1000, features: int = 6, seed: int = 0) -> DataFrame:
    """f0..., y, s: a logit of the first feature and the group, with noise."""
    d = spark.range(n).select(*[F.randn(seed + i).alias(f"f{i}") for i in range(features)], (F.rand(seed + 100) < 0.5).cast("int").alias("s"), F.randn(seed + 101).alias("e"))
    return d.withColumn("y", (0.9 * F.col("f0") + 0.3 * F.col("s") + F.col("e") > 0).cast("int")).drop("e")


def benchmark_sample(spark: SparkSession, n: int = 100_000, seed: int = 7) -> DataFrame:
    """Five unequal groups, two more attributes, binary and real-valued outcomes."""
    d = spark.range(n).withColumn("u", F.rand(seed))
    race = F.when(F.col("u") < 0.5, "R1").when(F.col("u") < 0.7, "R2").when(F.col("u") < 0.85, "R3").when(F.col("u") < 0.95, "R4").otherwise("R5")
    d = d.select(race.alias("race"), F.when(F.rand(seed + 1) < 0.5, "F").otherwise("M").alias("gender"), F.element_at(F.array(F.lit("young"), F.lit("middle"), F.lit("old")), (F.floor(F.rand(seed + 2) * 3) + 1).cast("int")).alias("age_group"), (F.rand(seed + 3) < 0.5).cast("int").alias("y_true"), (F.rand(seed + 4) < 0.5).cast("int").alias("y_pred"), F.randn(seed + 5).alias("y_reg"), F.randn(seed + 6).alias("e"))
    return d.withColumn("y_hat", F.col("y_reg") + 0.5 * F.col("e")).drop("e")

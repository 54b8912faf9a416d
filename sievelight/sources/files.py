"""Sources and sinks: module folders, sequences with their vocabulary, evidence, models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml


def modules(spark: SparkSession, *paths: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Files `*.wasm` of folders (not below them) or single files: path, class (its folder), name, size, bytes. Size
    limits reach the file listing, so other files are never opened."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.wasm").load(list(paths))
    f = f.filter(F.col("length") >= least) if least else f
    f = f.filter(F.col("length") <= most) if most is not None else f
    return f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("content").alias("bytes"))


def write_modules(spark: SparkSession, folder: str, files: dict[str, bytes]) -> None:
    """Emits fixture modules through the file system of the folder."""
    jvm = spark.sparkContext._jvm
    for name, data in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data))
        out.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()).strip()


def write_sequences(df: DataFrame, path: str) -> None:
    """JSON lines and a sidecar with the token table."""
    df.write.mode("overwrite").json(path)
    _write_text(df.sparkSession, f"{path}.vocab", json.dumps({"version": 1, "length": ml.SEQUENCE_LENGTH, "tokens": [*ml.SPECIAL, *ml.VOCABULARY]}))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """First row of each sha256, by file and place in it; a token table of another order is refused, and so are labels that
    aren't 0 or 1."""
    if json.loads(_read_text(spark, f"{path}.vocab"))["tokens"] != [*ml.SPECIAL, *ml.VOCABULARY]:
        raise ValueError("the sequences have another token table")
    df = spark.read.schema("sha256 string, tokens array<int>, label int, source string, kernel boolean, real_tokens long").json(path)
    if not df.filter(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).isEmpty():
        raise ValueError("a label is neither 0 nor 1")
    at = df.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row")).alias("_at"))
    return at.groupBy("sha256").agg(F.min_by(F.struct("tokens", "label", "source", "kernel", "real_tokens"),
        "_at").alias("r")).select("sha256", "r.*")


def write_evidence(df: DataFrame, path: str, name: str) -> None:
    """One JSON text a module, in a folder by name."""
    df.select(name, F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def write_model(spark: SparkSession, model: dict, path: str) -> None:
    ml.check_model(model)
    _write_text(spark, path, json.dumps(model))


def read_model(spark: SparkSession, path: str, names: list[str] | None = None) -> dict:
    """names: the columns that the model is to be used on; one made for others is refused."""
    model = json.loads(_read_text(spark, path))
    ml.check_model(model, names)
    return model


def read_model_or_none(spark: SparkSession, path: str) -> dict | None:
    """An optional model: none where there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return read_model(spark, path)
    except AnalysisException:
        return None

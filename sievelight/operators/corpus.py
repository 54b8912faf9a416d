"""Corpus work: gates, exact and near duplicates, holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

LEAST, MOST, COVERAGE = 1_024, 20 << 20, 0.9


def gate(size: Column, magic: Column, parsed: Column, coverage: Column) -> Column:
    """First failed test, null where none; sizes come first, so that bytes are only read for what they leave."""
    return F.when(size < LEAST, "too-small").when(size > MOST, "too-large").when(~magic, "not-wasm-magic").when(~parsed,
        "parse-failed").when(coverage < COVERAGE, "low-coverage")


def rejections(df: DataFrame, klass: str, reason: str) -> DataFrame:
    return df.groupBy(klass, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def exact_dedupe(df: DataFrame, klass: str, key: str, name: str) -> DataFrame:
    """First name of each (class, hash), with the number of copies; hashes found in several classes are left whole."""
    hashes = df.groupBy(key).agg(F.count_distinct(klass).alias("_k")).filter("_k > 1").select(key)
    both = df.join(hashes, key, "left_semi").select(klass, key, name).withColumn("copies", F.lit(1).cast("long"))
    one = df.join(hashes, key, "left_anti").groupBy(klass, key).agg(F.min(name).alias(name), F.count("*").alias("copies"))
    return one.select(klass, key, name, "copies").unionByName(both)


def contradictions(df: DataFrame, klass: str, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(klass).alias("classes"), F.count("*").alias("n")).filter("classes > 1")


def holdout(h: Column) -> Column:
    return F.substring(h, -1, 1).isin("0", "1", "2")


def cosine(a: Column, b: Column) -> Column:
    """Both zero: 1; one zero: 0."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda m, v: m + v)
    na, nb = total(a, a), total(b, b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(total(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def keep_first(clusters: DataFrame, name: str) -> DataFrame:
    return clusters.groupBy("seed").agg(F.min(name).alias("kept"), (F.count("*") - 1).alias("collapsed"))


def largest_first(files: DataFrame, folder: str) -> DataFrame:
    """Adds the place of each file in its folder, the largest first, by path where sizes are equal; a folder of any size is counted
    by ranges."""
    return scans.scanned(files.withColumn("_size", -F.col("length")), folder, ["_size", "path"], sums={"place": F.lit(1).cast("long")}).drop("_size")

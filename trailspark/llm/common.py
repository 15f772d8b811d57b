"""Helpers the operators share: tables, stored intermediates, document keys, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.session import scratch_path

NO_ID = -(1 << 63)  # stands for a null doc_id where joins need a value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: later jobs start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; rows that repeat id and text are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, ``_key`` and the named columns only, so that extra columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), *columns)


def same_document(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins whole documents with decisions (doc_id, _key, ...); a null id equals a null id.

    The decisions' columns other than the key are kept by a left or inner join.
    """
    named = other.withColumnRenamed("doc_id", "_llm_id").withColumnRenamed("_key", "_llm_key")
    joined = docs.join(
        named,
        docs["doc_id"].cast("long").eqNullSafe(named["_llm_id"]) & (text_key(docs["text"]) == named["_llm_key"]),
        how,
    )
    return joined.drop("_llm_id", "_llm_key")


def smaller_before(counts: DataFrame, by: list[str], order: str, bucket: Column) -> DataFrame:
    """Adds ``before``: the sum of n over smaller ``order`` values of the same ``by`` group.

    Sums run over buckets first, then inside each, so that a large group is many tasks' work.
    """
    binned = counts.withColumn("_bin", bucket)
    sums = binned.groupBy(*by, "_bin").agg(F.sum("n").alias("_n"))
    over_bins = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bin", F.coalesce(F.sum("_n").over(over_bins), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = binned.withColumn("_inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return inner.join(sums, [*by, "_bin"]).withColumn("before", F.col("_base") + F.col("_inner")).drop("_bin", "_base", "_inner")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of undirected ``edges`` (a, b); component is the least node.

    Alternating large-star and small-star rounds. Minima are aggregated before they are
    joined back, so that a hub is an ordinary skewed join, which Spark splits. Each round is
    stored; only its row count and checksum reach the driver.
    """

    def signature(frame: DataFrame):
        row = frame.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        return tuple(row)

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"))

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, f"{name}-edges")
    before = signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).select("m_a", F.least("m", "m_a").alias("m"))
        large = both.join(low, F.col("a") == F.col("m_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), f"{name}-large")
        low = least(large)
        small = large.join(low, F.col("a") == F.col("m_a")).select(
            F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", "b"))).otherwise(
                F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
            )).alias("e")
        ).select("e.a", "e.b")
        edges = stored(small.distinct(), f"{name}-small")
        after = signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

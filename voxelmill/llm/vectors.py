"""What the two vector searches share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, *, zero: bool) -> DataFrame:
    """vec_id and x (array of double) of the vectors that take part: with an id, of the most
    frequent length (of equally frequent ones the shorter), all components finite, and not all
    zero unless ``zero``."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = rows.filter("vec_id is not null and x is not null and size(x) > 0").filter(finite)
    if not zero:
        rows = rows.filter(F.exists("x", lambda v: v != 0))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("x") == (sizes["d"] if sizes else 0))


def one_query_each(queries: DataFrame) -> DataFrame:
    """Of query rows that share a vec_id, the one with the least vector."""
    return queries.groupBy("vec_id").agg(F.min("x").alias("x"))


def shard_of(shards: int):
    """The shard of a data row. The partition it was read in counts too, so rows that repeat very
    often are spread; a task that is run again reads the same partition."""
    return F.pmod(F.xxhash64("vec_id", "x", F.spark_partition_id()), F.lit(shards)).cast("int")


def bounded_sample(rows: DataFrame, most: int):
    """The ids and vectors of the ``most`` rows whose ids have the least hashes, on the driver."""
    import numpy as np

    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow().to_pydict()
    return np.array(got["vec_id"], dtype=np.int64), np.array(got["x"], dtype=np.float64).reshape(len(got["x"]), -1 if got["x"] else 0)


def matrix(table, name: str = "x"):
    """A list column of equal lengths as a matrix of doubles."""
    import numpy as np

    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def ranked(found: DataFrame, k: int, score) -> DataFrame:
    """The first ``k`` rows of each query by ``score``, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

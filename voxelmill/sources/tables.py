"""The driver's relational tables read as voxel data.

Grid L has a column for each ``l_quantity``, a row for each discount of 0 to 10 % and a plane for
each ``l_linenumber``; planes lie at irregular distances, so their thickness matters. The field is
the mean extended price of the line items in a voxel.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators.grid import Grid, create_grid
from voxelmill.sources import dicom

HEIGHTS = (0.0, 2.0, 4.0, 7.0, 9.0, 12.0, 14.0)
GRID = create_grid(11, 50, planes=[(0.0, 0.0, z) for z in HEIGHTS], spacing=(2.0, 1.0), frame_uid="1.2.3")
#: A coarser grid over part of Grid L, for resampling.
TARGET: Grid = create_grid(8, 30, planes=[(1.25, 0.75, z) for z in (0.5, 3.0, 5.5, 8.0, 11.0, 13.5)], spacing=(2.5, 1.5), frame_uid="1.2.3")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that queries write: below ``spark.checkpoint.dir``, which a cluster
    shares; a session of one process may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/voxelmill"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back, so that it is made once however often it is
    read. Without dictionaries: they would hold whole documents once more."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, r, c, v, n and tax (cents) of the populated voxels: one partial aggregation of four columns."""
    key = [(F.col("l_linenumber") - 1).cast("int").alias("k"), F.round(F.col("l_discount") * 100).cast("int").alias("r"), (F.col("l_quantity") - 1).cast("int").alias("c")]
    cents = lambda column: F.sum(F.round(F.col(column) * 100).cast("long"))
    rows = read(spark, sf_dir, "lineitem").groupBy(*key).agg(cents("l_extendedprice").alias("p"), F.count("*").alias("n"), cents("l_tax").alias("tax"))
    return rows.select("k", "r", "c", (F.col("p") / 100.0 / F.col("n")).alias("v"), "n", "tax")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).select("k", "r", "c", "v")


def mask(spark: SparkSession, sf_dir: str, name: str, mask_id: str | None = None) -> DataFrame:
    """A: prices of 53,000 and up; B: a mean tax of 4 cents and up; C: prices of 60,000 and up."""
    rule = {"A": "v >= 53000", "B": "tax >= 4 * n", "C": "v >= 60000"}[name]
    return voxels(spark, sf_dir).filter(rule).select(F.lit(mask_id or name).alias("mask_id"), "k", "r", "c")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A, B and C as one table, from one pass over the line items."""
    rules = (("A", "v >= 53000"), ("B", "tax >= 4 * n"), ("C", "v >= 60000"))
    named = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in rules)))
    return voxels(spark, sf_dir).select(F.explode(named).alias("mask_id"), "k", "r", "c")


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed outline for each user with three events or more; corners are exact quarters of a
    pixel. Masks take the users modulo 5, planes the users modulo 7; every third has a reference."""
    x = (F.col("event_id") * 7919 + F.col("user_id") * 13) % 197 / 4.0
    y = (F.col("event_id") * 104729 + F.col("user_id") * 7) % 43 / 2.0
    z = F.array(*map(F.lit, HEIGHTS))[(F.col("user_id") % 7).cast("int")]
    item = F.struct("event_id", F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("p"))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items")).filter(F.size("items") >= 3)
    refs = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("1.9.0"), F.concat(F.lit("1.9."), ((F.col("user_id") + 1) % 7 + 1).cast("string")))).when(F.col("user_id") % 3 == 1, F.array(F.lit("1.9.99"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.concat(F.lit("roi"), (F.col("user_id") % 5).cast("string")).alias("mask_id"), F.col("user_id").cast("int").alias("contour_no"), F.lit("CLOSED_PLANAR").alias("geometric_type"), F.transform("items", lambda i: i["p"]).alias("points"), refs.alias("sop_refs"))


def structure_files(outlines: DataFrame, **options) -> DataFrame:
    """Contours (see ``contours``) as one structure set, written in the tasks: doc, content."""
    return settled(dicom.write_structure_sets(outlines.withColumn("doc", F.lit("set")), **options), "structure_set")


def read_back(files: DataFrame) -> DataFrame:
    """The contours of ``structure_files``, dealt anew: one task reads a document, many work on it."""
    return settled(dicom.read_contours(files).repartition("mask_id", "contour_no"), "outlines")


def slices(spark: SparkSession) -> DataFrame:
    """A slice UID for each plane of Grid L."""
    return spark.createDataFrame([(f"1.9.{k + 1}", k) for k in range(len(HEIGHTS))], "sop_uid string, k int")


def plane_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id, i, proj: an order's line items as planes, at heights that sometimes nearly repeat."""
    tenths = F.round(F.col("l_quantity") * 10).cast("long") + F.col("l_suppkey") % 3
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grid_id"), tenths.alias("t")).agg(F.min("l_linenumber").alias("i"))
    return rows.select("grid_id", "i", (F.col("t") / 1000.0).alias("proj"))

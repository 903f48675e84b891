"""What the operators share: tables, scratch tables in the shared folder, Arrow helpers and components."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import cut_lineage, temporary_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; a temporary one on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(temporary_folder())
    return context.getCheckpointDir()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: work that several later steps read is done once and outlives its executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more: what was made from them is written itself."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def arrow(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that memory follows the longest text and not the batch length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit // max(limit, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Every round hooks a node to its smallest neighbour, shortens the chains and contracts the graph to
    what is left, so the edges shrink at least by the hooked nodes.  Minima are combined before each
    shuffle and no neighbour list is built, so a hub costs no more than any other node.
    """
    live = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    live = cut_lineage(live)
    roots = None
    while not live.isEmpty():
        ends = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"))
        hooked = cut_lineage(hooked)
        up = hooked.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hooked = cut_lineage(hooked.join(up, "p").select("u", F.col("pp").alias("p")))
        if roots is None:
            roots = hooked.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = hooked.select(F.col("u").alias("root"), "p")
            roots = cut_lineage(roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        left, right = hooked.toDF("u", "pu"), hooked.toDF("v", "pv")
        live = cut_lineage(live.join(left, "u").join(right, "v").where("pu <> pv")
                           .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if roots is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).where("false")
    return roots

"""Layer tables: read with a helpful error, write partitioned and sorted."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

BUILD_STEP = {"silver": "touchline.plans.lake.build_silver", "gold": "touchline.plans.lake.build_gold"}


class MissingTable(FileNotFoundError):
    """A layer table was not built yet."""


#: Names the folder of a layer's published tables; it is written last.
MARKER = "_published"


def publish(spark: SparkSession, lake: str, layer: str, version: str) -> None:
    """From now on ``load`` reads the tables of ``version``; one small file is replaced, so a reader sees the old tables or the new ones."""
    path, fs = _marker(spark, lake, layer)
    out = fs.create(path, True)
    out.write(bytearray(version.encode()))
    out.close()


def _marker(spark: SparkSession, lake: str, layer: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{lake}/{layer}/{MARKER}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, lake: str, layer: str) -> str:
    """The folder of a layer's published tables; the layer's own folder if nothing was published."""
    path, fs = _marker(spark, lake, layer)
    if not fs.exists(path):
        return f"{lake}/{layer}"
    stream = fs.open(path)
    version = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream)).readLine()
    stream.close()
    return f"{lake}/{layer}/{version}"


def load(spark: SparkSession, lake: str, layer: str, table: str) -> DataFrame:
    path = f"{published(spark, lake, layer)}/{table}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        raise MissingTable(f"{path} is missing; run {BUILD_STEP.get(layer, 'its build step')} first") from exc


def save(df: DataFrame, lake: str, layer: str, table: str, sort: Sequence[str] = (), part: Column | None = None) -> None:
    """Write a table.  ``sort`` range-partitions and sorts, so that row groups can be skipped on it.

    Range partitioning splits by row counts, so a match with most of the rows is spread over many files.
    ``part`` lays the table out in one folder per value (column ``part``), which a scan can leave out.
    """
    write(df, f"{lake}/{layer}/{table}", sort, part)


def write(df: DataFrame, path: str, sort: Sequence[str] = (), part: Column | None = None, dealt: bool = False, codec: str | None = None) -> None:
    """``save`` to a path.  Rows that are ``dealt`` already lie together as the files should; they are sorted where they are.

    ``codec`` names a compression other than the session's.
    """
    out, order = (df, [*sort]) if part is None else (df.withColumn("part", part), ["part", *sort])
    if order:
        out = (out if dealt else out.repartitionByRange(*order)).sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    if codec is not None:
        writer = writer.option("compression", codec)
    (writer if part is None else writer.partitionBy("part")).parquet(path)

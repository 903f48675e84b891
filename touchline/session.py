"""Session helpers: recommended settings and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "16g", app: str = "touchline") -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_temporary: list[tempfile.TemporaryDirectory] = []


def temporary_folder() -> str:
    """A folder for a local master without a named one (a laptop, a test); it goes when the process ends."""
    if not _temporary:
        _temporary.append(tempfile.TemporaryDirectory(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"), ignore_cleanup_errors=True))
    return _temporary[0].name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; a temporary one on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named or temporary_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only where no folder is named at all (a laptop, a test) is a temporary one set, because a
    machine-local folder would be lost together with its executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or temporary_folder())
    return df.checkpoint(eager=True)


#: Bytes of code beyond which the JVM never compiles a method, so that it stays interpreted.
COMPILED_METHOD = 8000


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside generate no method that is too long to be compiled.

    A projection of many long expressions is one method with whole-stage code; beyond ``COMPILED_METHOD`` bytes
    Spark is told to run it as the smaller methods of its plain plan.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), COMPILED_METHOD)))
    try:
        yield
    finally:
        spark.conf.set(name, before)

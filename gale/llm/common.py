"""Helpers shared by the corpus operators: text normalisation, shared tables, fresh names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gale.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the names the operator uses; whatever else
    the input carries (clashing names too) is left behind."""
    return df.select(*[F.col(f"`{c}`").alias(a) for a, c in names.items()])


def ascii_lower(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, every other character unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name = "_" + name
    return name


def id_hash(c: Column) -> Column:
    """crc32 of an id written as text (null: as the empty text)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs started inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of one Arrow batch: whole texts, held off-heap by the JVM and again by the Python worker.
BATCH_ROWS = 1000


class Scratch:
    """Tables an operator writes in the cluster's shared checkpoint folder.

    A written table cuts lineage: tasks lost with an executor are rerun from
    these files, not from the start. ``drop`` removes a table that no later
    step reads. The session's Arrow batches are held to ``BATCH_ROWS`` rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)

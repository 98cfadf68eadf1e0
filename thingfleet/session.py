"""Session defaults and the shared folder used to cut lineage and to hold written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even when that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def builder(app: str = "thingfleet", **conf: str) -> SparkSession.Builder:
    """A session builder with the settings the operators are tuned for."""
    b = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        b = b.config(key, value)
    return b


def tune(spark: SparkSession) -> SparkSession:
    """Turn on adaptive skew handling in a session somebody else made."""
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql.adaptive"):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a new local one when running in local mode without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="thingfleet-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Folders of tables that go when :func:`passing` ends.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def kept(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its plan starts anew at a scan. With ``stay`` it outlasts :func:`passing`."""
    path = scratch(df.sparkSession, name)
    if (made := _passing.get()) is not None and not stay:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Work whose tables are no longer read when it ends: what is :func:`kept` meanwhile is deleted then, and shuffle
    files go as soon as the job that made them ends, not when the driver happens to collect its garbage."""
    made: list[str] = []
    skipped = "spark.sql.adaptive.optimizer.excludedRules"
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        # a plan that is found empty halfway ends while its other stages run on, and their files would be gone
        skipped: f"{spark.conf.get(skipped, None) or ''},org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation".lstrip(","),
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    token = _passing.set(made)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        _passing.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def kept_by(df: DataFrame, name: str, by: str, parts: int) -> DataFrame:
    """:func:`kept`, in ``parts`` buckets of column ``by``: joins and windows on it read rows where they belong and
    shuffle nothing. A task writes a file for each bucket it has rows of, so ``df`` should come dealt likewise."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    # a column read under a name of its own bears no mark of the table, by which a union would not know its buckets
    away = f"__{by}"
    df.withColumnRenamed(by, away).write.bucketBy(parts, away).option("path", scratch(spark, name)).saveAsTable(table)
    out = spark.table(table).withColumnRenamed(away, by)
    # the files stay, and what has been read from them knows its buckets
    spark.sql(f"DROP TABLE {table}")
    return out


#: Rows of an input that one task takes on ahead of heavy row work.
ROWS_A_PART = 25_000


def parts_of(df: DataFrame, rows: int = ROWS_A_PART) -> int:
    """A part for every core, and as many that none has more than some ``rows``."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int = ROWS_A_PART) -> DataFrame:
    """Share out the rows of an input ahead of heavy row work: a part for every core, and no part of more than some
    ``rows``, so that tasks stay short however large the input is.

    Filters that come later stay behind the shuffle: pushed below it, they would do the heavy work in the few
    parts of the input.
    """
    parts = parts_of(df, rows)
    if df.rdd.getNumPartitions() >= parts:
        return df
    # no filter moves below a generator whose columns it reads
    return df.repartition(parts).select(F.inline(F.array(F.struct("*"))))

"""Session, lineage and sizing helpers shared by all operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

#: Whether Spark removes the shuffle files of a plan at the end of its action.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="catalink-"))
    return sc._jsc.sc().getCheckpointDir().get()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's name within the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; Spark drops it once nothing refers to it, where it is told to.

    The files are compressed columns, since a checkpoint's plain rows take several times the disk. They are read as rows
    without an estimate of their size: that of a file would be taken for that of its rows. Shuffle files of a plan that has
    been written serve no other plan; they go at its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext._jsc.sc()
    # Spark's cleaner knows checkpoints by the number of their RDD.
    number = sc.newRddId()
    path = f"{shared_folder(spark).rstrip('/')}/rdd-{number}"
    places = [f"c{i}" for i in range(len(df.columns))]
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        # A plan of its own: what else is made of df shuffles for itself.
        df.toDF(*places).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    kept = spark.read.schema(StructType([StructField(p, f.dataType) for p, f in zip(places, df.schema.fields, strict=True)])).parquet(path)._jdf
    rows = kept.queryExecution().toRdd().setName(path)
    if spark.sparkContext.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints", "false") == "true" and sc.cleaner().isDefined():
        sc.cleaner().get().registerRDDCheckpointDataForCleanup(rows, number)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept.schema(), False), spark).toDF(*df.columns)


def discard(kept: DataFrame) -> None:
    """Remove the files of a table that cut() made and that nothing reads any more."""
    jvm, sc = kept.sparkSession._jvm, kept.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(kept._jdf.queryExecution().logical().children().head().rdd().name())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only where the rows were measured to take at most `limit` bytes; otherwise the join shuffles.

    df should be a kept or checkpointed table: it is read once to be measured.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df

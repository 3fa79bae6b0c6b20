"""Lineage cuts and run-time settings that hold on a cluster.

Intermediate tables go to the folder every executor shares, the one the session
names in ``spark.checkpoint.dir``.  Where that is unset, a local master (unit
tests, a laptop) gets a temporary folder of this machine, recorded in the session;
on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWN = "millrace.scratch.dir"
#: Rows and bytes of one Arrow batch, the same for all operators: frames are lazy, so a
#: value of one operator's own would reach whichever frame runs next.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    named = spark.conf.get(_KEY, None) or spark.conf.get(_OWN, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_OWN, named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result no longer depends on executors that hold shuffle blocks, and
    anything nondeterministic above it (row numbers, partition ids) is fixed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/millrace/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            if store.makeQualified(path).toString().startswith(own):
                store.delete(path, True)


def bounded_arrow_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and by bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Session set-up, shared scratch folders and literal tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Larger generated methods are never compiled by the JVM; smaller functions are better.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


# One shuffle partition per so many bytes of input, within bounds the driver can track.
BYTES_PER_PARTITION = 256 * 1024**2
PARTITION_BOUNDS = (200, 40_000)


def shuffle_partitions(input_bytes: int) -> int:
    """Partitions to start with for an input of a size; AQE merges those that stay small."""
    low, high = PARTITION_BOUNDS
    return min(max(input_bytes // BYTES_PER_PARTITION, low), high)


def build_session(
    app: str = "wavebook",
    master: str | None = None,
    input_bytes: int | None = None,
    scratch: str | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution, ANSI casts and UTC dates.

    ``master`` is left to spark-submit unless given. ``input_bytes`` sizes the
    shuffles for a large input. ``scratch`` is the folder for tables between steps,
    which all executors must share; a cluster's own ``spark.checkpoint.dir`` wins.
    """
    if scratch is not None:
        conf = {"spark.checkpoint.dir": scratch, **conf}
    if input_bytes is not None:
        conf = {"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes)), **conf}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and the session is local, as in tests, a folder of this
    machine is made, and deleted at the end; executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="wavebook-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, deleted when the program ends.

    Results are lazy, so it must stay until then.
    """
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is None or jsc.sc().isStopped():
        return
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there.

    Used where two branches of a plan must see the very same rows, or where a
    reduced table is measured before it is used. Survives lost executors.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """A table of literal rows whose size Catalyst knows.

    Going through Arrow gives a local relation, so joins against it are
    broadcast by Spark's own size check.
    """
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))

"""Session helpers: local sessions for tests and bench, and shared scratch space."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packetscope")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # wide projections make generated methods the JIT would otherwise skip
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# stands in for the shared folder where a local session names none
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local path would lose data together with the executor that wrote it.
    """
    global _own_dir
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _own_dir = folder = _own_dir or tempfile.mkdtemp(prefix="packetscope-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused."""
    return os.path.join(shared_dir(spark), "packetscope", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder.

    For results that are read many times: what made them is not run again, and a
    lost executor costs only a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession) -> None:
    """Have shuffles deleted that nothing reads any more.

    Spark does so when the driver's garbage is collected, which may be long after; until then
    the files of one step lie beside those of the next.
    """
    gc.collect()
    spark._jvm.System.gc()


_shipped: set[str] = set()


# bytes of rows that go to a worker at one time: the JVM holds several copies of each batch
# outside its heap, and the worker one or two
BATCH_BYTES = 8 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let batches to workers be of at most ``BATCH_BYTES``; a lower limit of the session stays."""
    limit = int(spark.conf.get(_BATCH_LIMIT).rstrip("b"))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers import it when they run a UDF or a data source. Executors need
    neither the driver's folder nor its path. Batches to them are small from then on.
    """
    small_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="packetscope-"), "packetscope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)

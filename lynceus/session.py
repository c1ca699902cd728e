"""Sessions and the shared folder where lineage is cut."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Masters whose executors are on this machine.
LOCAL_MASTER = re.compile(r"local(-cluster)?(\[.*\])?")
SPARK_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(master).appName("lynceus").config("spark.driver.memory", memory)
    for k, v in (SPARK_CONF | {"spark.sql.shuffle.partitions": str(partitions)}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master, as in tests, gets a temporary one; a cluster
    is refused, since its executors don't share a local disk."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not LOCAL_MASTER.fullmatch(spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lynceus-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: work is done once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lynceus-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    own = getattr(_SCRATCH, "paths", None)
    (_WRITTEN.setdefault(spark.sparkContext.applicationId, []) if own is None else own).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def written_lines(df: DataFrame) -> str:
    """The one text column as lines of files in the shared folder, in order of their names; gives the folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lynceus-{uuid.uuid4().hex}"
    df.write.option("lineSep", "\n").text(path)
    own = getattr(_SCRATCH, "paths", None)
    (_WRITTEN.setdefault(spark.sparkContext.applicationId, []) if own is None else own).append(path)
    return path


_WRITTEN: dict[str, list[str]] = {}
_SCRATCH = threading.local()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` returned and nothing reads any more, such as the generation before in a loop."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path is None:
            continue
        spark = t.sparkSession
        for held in (_WRITTEN.get(spark.sparkContext.applicationId), getattr(_SCRATCH, "paths", None)):
            if held and path in held:
                held.remove(path)
        _delete(spark, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end, so their results must be consumed by then."""
    outer = getattr(_SCRATCH, "paths", None)
    _SCRATCH.paths = mine = []
    try:
        yield
    finally:
        _SCRATCH.paths = outer
        _delete(spark, mine)


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffles, broadcasts and plans that nothing reads any more; iterative operators call it once a round, since files of shuffles
    and memory of the driver are otherwise kept until its garbage happens to be collected. What the driver's JVM has freed outside its heap goes
    back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> str | None:
    """Freed native memory of the driver's JVM given back to the system: compilers and codecs free much that malloc keeps. What the JVM says of it;
    None where it has no such command (before JDK 17.0.9, or outside Linux)."""
    j, g = spark._jvm, spark.sparkContext._gateway
    java, cls = j.java.lang, j.java.lang.Class

    def array(kind, *xs):
        out = g.new_array(kind, len(xs))
        for k, x in enumerate(xs):
            out[k] = x
        return out

    try:
        beans = java.management.ManagementFactory.getPlatformMBeanServer()
        kinds = [cls.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = cls.forName("javax.management.MBeanServer").getMethod("invoke", array(cls, *kinds))  # the server's own class is not exported
        command = j.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(beans, array(java.Object, command, "systemTrimNativeHeap", array(java.Object), array(java.String)))
    except Py4JError:
        return None


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application wrote to the shared folder, once all results that read them are consumed."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def width(spark: SparkSession) -> int:
    """Tasks that keep all cores busy: the cores there are, or the shuffle partitions that the session asks for if those are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """The rows over enough tasks for work in Python. A scan that has fewer tasks than there are cores is small, so moving it costs
    little; any larger one stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

"""Session settings for local runs; on a cluster the session is given."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tarnish", cpus: str = "8", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where that is unset, in a local test, a temporary folder stands in.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tarnish-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back; ``options`` are the writer's.

    Later scans prune columns and push filters down, and a lost executor costs a re-read
    instead of the work that made the rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lease = _LEASE.get() or _whole_session(spark)
    lease.paths.append(path)  # before writing, so that a failed write goes as well
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows written once, dealt over the whole cluster by ``columns`` (without any, evenly).

    Compressed tables of few bytes are read by few tasks, however many rows they hold; a learner
    that goes over its rows hundreds of times would leave the other cores idle.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(rows.repartition(parts, *columns))


class Lease:
    """The folders of stored steps, deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def release(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            folder.getFileSystem(conf).delete(folder, True)


_LEASE: ContextVar[Lease | None] = ContextVar("lease", default=None)
_WHOLE: dict[str, Lease] = {}


@contextmanager
def stored_steps(spark: SparkSession) -> Iterator[Lease]:
    """Steps stored inside are deleted at the end, also after a failure; results must be read or written by then.

    Leases nest, and threads started through ``inherited`` count to the lease they come from.
    Steps stored outside of any lease go when Python ends, if the session still runs then.
    """
    lease = Lease(spark)
    token = _LEASE.set(lease)
    try:
        yield lease
    finally:
        _LEASE.reset(token)
        lease.release()


def inherited(function: Callable) -> Callable:
    """``function`` for another thread, under the lease of this one."""
    lease = _LEASE.get()

    def run(*args: object) -> object:
        token = _LEASE.set(lease)
        try:
            return function(*args)
        finally:
            _LEASE.reset(token)

    return run


def _whole_session(spark: SparkSession) -> Lease:
    """The lease of what is stored outside of any other, ended with the process."""
    name = spark.sparkContext.applicationId
    if name not in _WHOLE:
        _WHOLE[name] = Lease(spark)
        atexit.register(_end, name)
    return _WHOLE[name]


def _end(name: str) -> None:
    lease = _WHOLE.pop(name, None)
    if lease is not None and lease.spark.sparkContext._jsc is not None:
        with suppress(Py4JError, OSError):  # the session's process may have ended first
            lease.release()


# The JVM interprets methods of more bytecode than this for good, at a tenth of the speed or less.
JIT_BYTES = 8000


def jit_sized(spark: SparkSession) -> None:
    """Let Spark generate one class per expression where a whole stage would be too long a method to be compiled.

    Its own bound is what a class file can hold.  A lower one that the session sets stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, str(JIT_BYTES + 1))) > JIT_BYTES:
        spark.conf.set(name, str(JIT_BYTES))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the session was started.

    The package goes to the executors as a file of the session, once; where the cluster has
    it installed or got it by ``--py-files``, workers find the same code.
    """
    context = spark.sparkContext
    if getattr(context, "_tarnish_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tarnish-code-"), "tarnish.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tarnish", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._tarnish_shipped = True

"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[object, str]] = []
_of_stage: set[str] = set()
_lasting: set[str] = set()
_in_stage = False


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master; on a cluster
    that is an error, as each machine would see a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = "file://" + tempfile.mkdtemp(prefix="docketlake-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/docketlake-{uuid.uuid4().hex[:12]}-{name}"
    _written.append((spark, path))
    if _in_stage:
        _of_stage.add(path)
    return path


#: Bytes of a batch of rows on its way to a Python worker; by rows alone a batch of long texts has no bound.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound what the JVM and a worker hold of a batch, unless the session was set up with a bound of its own."""
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


#: Rows that a task of a sized table writes.
ROWS_PER_TASK = 50_000


def staged(df: DataFrame, name: str, rows: int | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later steps neither recompute it nor depend on executors' disks.

    Where the number of ``rows`` is known to be small, few tasks write them;
    many rows keep all the partitions they have. ``discard`` deletes the table
    before the driver ends; ``discard_since`` leaves one that is ``lasting``.
    """
    path = new_path(df.sparkSession, name)
    if lasting:
        _lasting.add(path)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))
    # Hashes and sketches, most of what is written, have no dictionary worth building.
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    if rows is None:
        _release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docketlake_path = path
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``staged`` with a column node, a number that no other row has. Only what is written counts: a repeated task may number its rows anew."""
    return staged(df.withColumn("node", F.monotonically_increasing_id()), name)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``staged`` returned and that no later step reads."""
    for table in tables:
        if (path := getattr(table, "_docketlake_path", None)) is not None:
            delete(table.sparkSession, path)
            _lasting.discard(path)
            _written[:] = [entry for entry in _written if entry[1] != path]


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written after ``mark`` (an earlier ``len`` of them) but for those to keep and lasting ones."""
    kept = {getattr(table, "_docketlake_path", None) for table in keep} | _lasting
    for spark, path in [entry for entry in _written[mark:] if entry[1] not in kept]:
        delete(spark, path)
        _written.remove((spark, path))


def written() -> int:
    """How many tables stand in the shared folder."""
    return len(_written)


@contextlib.contextmanager
def stage() -> Iterator[None]:
    """Within a pipeline's stage. Its tables serve its result until that is written, so the next stage deletes them."""
    global _in_stage
    for spark, path in [entry for entry in _written if entry[1] in _of_stage]:
        delete(spark, path)
        _written.remove((spark, path))
    _of_stage.clear()
    _in_stage = True
    try:
        yield
    finally:
        _in_stage = False


#: Bytes on disk of a written table that may be sent to all tasks.
BROADCAST_BYTES = 4 << 20


def small_side(table: DataFrame) -> DataFrame:
    """A table that ``staged`` returned, marked for broadcast if its files are within the bound; a larger one is joined as Spark decides."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._docketlake_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that no plan refers to any more; it only notices when the driver collects garbage."""
    gc.collect(0)
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may already be gone at interpreter exit
            return


atexit.register(_clean)

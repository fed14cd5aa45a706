"""Session helpers shared by the operators: sizing, shared storage, key columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text that one grouped batch should hold.  A batch is what one Python call
#: sees at once, so this bounds worker memory whatever the corpus size.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only where the setting is absent in local mode (tests, notebooks) a folder is made
    and set; on a cluster the configured one is always used, and must be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="treeloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


#: Bytes of an Arrow batch on its way to a Python worker.  The engine's default
#: allows 64 MB a batch, held by the JVM and the worker at once for every core.
ARROW_BYTES = 8 << 20
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches have been bounded by ``ARROW_BYTES``, unless the
    session has a setting of its own.  Batches are cut when a plan runs, not when it is made,
    so the bound stays set for the session; it changes no result."""
    conf = df.sparkSession.conf
    now = conf.get(_ARROW_SETTING).lower().rstrip("b")
    if now == str(_ARROW_DEFAULT):
        conf.set(_ARROW_SETTING, str(ARROW_BYTES))
    return df


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, until ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/treeloom/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders, all that this process has made unless some are named.  Results
    that read them must have been written or collected before."""
    jvm = spark._jvm
    for path in paths or tuple(_scratch):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scratch.remove(path)


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id column as bigint; TypeError at once, rather than in a task, if it isn't of integers."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"column {id_col} must hold integers, not {kind}")
    return F.col(id_col).cast("bigint")


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage.

    Each partition is a file of its own there.  ``files`` merges partitions whose
    last stage is light, so that a small table isn't spread over many files.
    """
    shared_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """``df``, a cut one, without Catalyst's size estimate, which ``cut`` hands on.

    Estimates of joins are products, so those of a table that is joined with itself and cut
    again and again grow by their own power: after some rounds the number has over 4,300
    digits, which Python refuses to read, and in the end more than the JVM can hold.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def few(df: DataFrame) -> int:
    """Files for tables of small rows made from ``df``: an eighth of the shuffle partitions, and
    one for each half GB of ``df`` at least, so that none grows with the corpus."""
    base = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    size = input_bytes(df)
    return base if size > 1 << 60 else max(base, -(-size // (512 << 20)))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan), at most what its sources
    hold together: estimates of joins are products."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    held = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), held)


def parts(df: DataFrame, unit: int = BATCH_BYTES) -> int:
    """How many groups of about ``unit`` bytes ``df`` makes; grows with the input.

    File sizes are compressed, so the estimate is doubled.  Never under the
    session's shuffle partitions, so small inputs still use all cores.
    """
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size > 1 << 60:  # unknown statistics: the rows are counted instead
        width = F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
        size = int(df.agg(F.sum(width)).first()[0] or 0)
    return max(floor, -(-2 * size // unit))


def small_side(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """``df`` for the small side of a join: broadcast if its rows, counted, take at most ``limit`` bytes."""
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def slot(n: int, *cols: Column) -> Column:
    """A stable group number in ``0..n-1`` from the values of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of_each(docs: DataFrame, keys: dict[str, Column], keep: DataFrame) -> DataFrame:
    """One row of ``docs``, whole, for each row of ``keep``.

    ``keys`` computes the key columns of a document, which ``keep`` has under the
    same names beside ``n``, the number of documents with that key.  Nulls match
    nulls.  Only keys held by several documents cost an aggregate.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(f"_{k}") for k, c in keys.items()))
    same = [rows[f"_{k}"].eqNullSafe(keep[k]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    found = rows.join(keep, on)
    once = found.where("n = 1").select("row.*")
    more = found.where("n > 1").dropDuplicates([f"_{k}" for k in keys]).select("row.*")
    return once.unionByName(more)

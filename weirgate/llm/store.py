"""Shared-folder tables and sizes: what every operator needs to cut lineage safely."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirgate.session import ship

_WRITTEN: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a temporary one on a local master, else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="weirgate-checkpoint-")
        atexit.register(_remove_local, root)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Lineage ends at files that every executor can read, so a lost executor costs a reread, and row
    numbers given before the write stay what they are afterwards.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/weirgate/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`materialize` wrote; call it once the results that read them are stored."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; Arrow batches are held to 2,000 rows and 4 MB for the session, so that the workers' batches fit beside the heap."""
    conf = ship(df.sparkSession).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def texts(docs: DataFrame, *columns) -> DataFrame:
    """doc_id as a long, then ``columns``, then the text as a string: what the Python operators read."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.col("text").cast("string").alias("text"))


#: From this on Catalyst's figure stands for an unknown size.
UNKNOWN = 1 << 59


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that ``df`` reads, by Catalyst's statistics; no job runs. ``UNKNOWN`` if some have none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return min(UNKNOWN, sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))


def parts_for(df: DataFrame, bytes_each: int, least: int = 12, most: int = 1 << 17) -> int:
    """Partitions so that each gets about ``bytes_each`` of the input; the session's number where the size is unknown."""
    size = plan_bytes(df)
    if size >= UNKNOWN:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(most, size // bytes_each + 1))


def heavy_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 256) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` with a ``right`` that has one row a key.

    Keys with more than ``rows / share`` rows of ``left`` (so fewer than ``share`` of them) meet a broadcast
    of their ``right`` rows; every other key takes the shuffle join, where none holds more than that part.
    """
    total = left.count()
    counts = left.groupBy(key).count().where(F.col("count") > max(1000, total // share))
    hot = [r[0] for r in counts.select(key).collect() if r[0] is not None]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return near.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


#: Rows of a table of keys that is broadcast at most.
BROADCAST_KEYS = 1 << 20


def row_hash() -> Column:
    """The hash of a row's text, which tells rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decided: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay by ``decided`` (doc_id, row_hash, stays: a row for each row), one of each repeated row.

    The keys that go, or that several staying rows share, are broadcast while there are at most ``most``, so that texts
    stay where they are read; more keys meet the rows in a shuffle join. Rows of one doc_id and text are repeated; the one
    whose other columns hash to the least stays. Column names may be any.
    """
    keys = decided.groupBy("doc_id", "row_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    marks = materialize(keys.where("not stays or rows > 1").select("doc_id", "row_hash", "stays"), "marks")
    if marks.isEmpty():
        return docs
    hashed, key, text, mark = (fresh(docs, f"{n}_of_row") for n in ("hash", "key", "text", "mark"))
    named = marks.select(F.col("doc_id").alias(key), F.col("row_hash").alias(text), F.col("stays").alias(mark))
    side = F.broadcast(named) if named.count() <= most else named
    left = docs.withColumn(hashed, row_hash())
    joined = left.join(side, left["doc_id"].cast("long").eqNullSafe(side[key]) & (left[hashed] == side[text]), "left")
    out = joined.where(F.col(mark).isNull()).select(*map(_quoted, docs.columns))
    if marks.where("stays").isEmpty():
        return out
    place = fresh(joined, "place")
    once = Window.partitionBy("doc_id", hashed).orderBy(F.xxhash64(*map(_quoted, docs.columns)))
    repeated = joined.where(F.col(mark)).withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return out.unionByName(repeated.select(*map(_quoted, docs.columns)))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")

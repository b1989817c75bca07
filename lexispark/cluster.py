"""Helpers for jobs on many executors: lineage cuts, checked broadcasts and lookups that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast only after counting that it has at most this many rows.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """One temporary folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="lexispark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of this run in the shared folder, for tables that are written and read again; removed when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended already; the folder's owner clears what is left
        pass


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (a shuffle join follows).

    ``df`` is evaluated to count it, so pass a checkpointed or cheap frame.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_lookup(
    big: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join ``big`` with ``small`` on ``on`` where a few keys may own a large part of ``big``.

    Rows of one key are spread over ``salts`` partitions by a hash of ``salt_by``; ``small``, which has few rows a key,
    is repeated once per salt.  Null keys never match.  ``how`` is inner, left, left_semi or left_anti.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread_lookup(
    big: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str], sizes: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join ``big`` with ``small`` on ``on``; keys get as many salts as their rows need, however large the largest is.

    ``sizes`` has ``n``, the rows of ``big`` for each value of its other columns, which are ``on`` or some of them (values may
    be missing, null keys never match).  A value with more rows than half a partition's share is hot: at most twice as many
    as there are partitions can be, so the list of hot ones is broadcast whatever the data.  Rows of a hot value are spread
    by a hash of ``salt_by``, the rows of ``small`` with it are repeated once a salt.  ``how`` is inner, left, left_semi or
    left_anti.
    """
    by = [c for c in sizes.columns if c != "n"]
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(total // (2 * parts), 1)
    hot = F.broadcast(  # at most 2 * parts rows
        sizes.where(F.col("n") > share).select(*by, F.ceil(F.col("n") / F.lit(share)).cast("int").alias("_salts"))
    )
    salt = F.pmod(F.xxhash64(*salt_by), F.coalesce("_salts", F.lit(1))).cast("int")
    left = big.join(hot, by, "left").withColumn("_salt", salt).drop("_salts")
    right = small.join(hot, by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return left.join(right.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def distinct_rows(df: DataFrame, keys: Sequence[str], wide: str) -> DataFrame:
    """``df`` with repeated rows of equal ``keys`` and ``wide`` dropped; other columns are those of one of them.

    Only keys and hashes are shuffled to find what stands more than once; the long texts in ``wide`` leave the scan only
    for those few rows.  Null keys and texts are values like any other.
    """
    rows = df.withColumn("_hash", F.sha2(F.coalesce(F.col(wide).cast("string"), F.lit("\0")), 256))
    by = [*keys, "_hash"]
    more = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    more = broadcast_if_small(checkpointed(more))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    once = rows.join(more, same, "left_anti")
    return once.unionByName(rows.join(more, same, "left_semi").dropDuplicates(by)).drop("_hash")


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], values: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Add ``<value>_upto``: the sum of each of ``values`` from the first row of a ``by`` group up to this one.

    A plain window would bring a whole group, or without ``by`` the whole table, into one task.  Here rows are range
    partitioned by ``by`` and ``order``, summed within partitions, and the sums of earlier partitions of the group are
    added.  ``order`` must be unique within a group; ``by`` may hold nulls.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = list(by)
    keys = [F.col(c) for c in by]
    # written, because partition numbers must not change between the two uses
    rows = checkpointed(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values])
    base = broadcast_if_small(checkpointed(base.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_base_part"), *[f"_base_{v}" for v in values])))
    same = F.col("_part") == F.col("_base_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.select("*", *[F.sum(v).over(local).alias(f"_local_{v}") for v in values]).join(base, same)
    return out.select(*df.columns, *[(F.col(f"_local_{v}") + F.col(f"_base_{v}")).alias(f"{v}_upto") for v in values])

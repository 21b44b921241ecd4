"""Writing matrices and stage results."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from featmatrix.config import KEYS


def repartition_for_write(
    df: DataFrame, partition: str = KEYS.period, single_partition: bool = True, files: int | None = None,
    keys: Sequence[str] = KEYS.ids,
) -> DataFrame:
    """Spread rows for a partitioned write.

    A frame of one month is already spread by its keys, and moving it by month would funnel it into
    one task, so it stays as it is (or goes to ``files`` writers by key). A narrow frame of several months
    can be rebalanced by month, which lets adaptive execution split the large months.
    """
    if single_partition:
        return df if files is None else df.repartition(files, *keys)
    return df.hint("rebalance", partition)


def spread_by_month(df: DataFrame, partition: str = KEYS.period, files: int | None = None) -> DataFrame:
    """Rows of many months, brought together for a partitioned write of ``files`` files a month.

    Otherwise every task writes a file of every month, and files grow with tasks times months. The number of tasks is
    fixed, and a month goes to more files as that grows (a twentieth of the tasks by default), whatever its ids.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files or max(1, tasks // 20)
    content = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return df.repartition(tasks, F.col(partition), F.pmod(content, F.lit(files)))


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Inserts into a table take the overwrite mode from the session, not from the writer."""
    option = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(option)
    spark.conf.set(option, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def write_matrix(
    df: DataFrame, table: str, partition: str = KEYS.period, months: Iterable[int | str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Overwrite only the month partitions present in ``df``.

    With ``months``, exactly the listed months are replaced: a row of any other month is an error and nothing is
    written, and a listed month without rows is cleared. The rows are counted while they are written.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c.lower() != partition.lower()] + [partition]
    df = df.select(*columns)
    listed = [] if months is None else sorted({int(m) for m in months})
    written = Observation() if listed else None
    if months is not None:
        df = _listed_only(df, partition, listed)
    if written is not None:
        df = df.observe(written, *(F.count_if(F.col(partition) == m).alias(f"m{m}") for m in listed))
    if spark.catalog.tableExists(table):
        known = [c.lower() for c in spark.table(table).columns]
        if known != [c.lower() for c in columns]:
            raise ValueError(f"columns of {table} differ from the columns to write")
        with _dynamic_overwrite(spark):
            df.write.insertInto(table, overwrite=True)
        if written is not None:
            for m in listed:
                if not written.get.get(f"m{m}"):
                    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({partition} = {m})")
    else:
        df.write.format(fmt).option("compression", "snappy").partitionBy(partition).saveAsTable(table)


def _listed_only(df: DataFrame, partition: str, listed: Sequence[int]) -> DataFrame:
    month = F.col(partition)
    message = F.concat(F.lit("a row of a month that is not listed: "), F.coalesce(month.cast("string"), F.lit("null")))
    return df.where(F.coalesce(month.isin(listed), F.lit(False)) | F.raise_error(message).cast("boolean"))


def partition_location(spark: SparkSession, table: str, month: int | str, partition: str = KEYS.period) -> str | None:
    """Folder that the catalog has for a month, None without such a partition.

    After ``swap_months`` a month need not lie where its name says, so readers by path ask here.
    """
    names = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table} PARTITION ({partition} = {int(month)})").collect()}
    if not names:
        return None
    rows = spark.sql(f"DESCRIBE FORMATTED {table} PARTITION ({partition} = {int(month)})")
    return rows.where("col_name = 'Location'").first()["data_type"]


def _table_location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]


def _point(spark: SparkSession, table: str, partition: str, month: int, folder: str | None, exists: bool) -> None:
    """Let the catalog find a month in a folder; without a folder the month is forgotten."""
    spec = f"PARTITION ({partition} = {month})"
    if folder is None:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {spec}")
    elif exists:
        spark.sql(f"ALTER TABLE {table} {spec} SET LOCATION '{folder}'")
    else:
        spark.sql(f"ALTER TABLE {table} ADD {spec} LOCATION '{folder}'")


def _folder(spark: SparkSession, path: str):
    """A path and the file system that it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete_folder(spark: SparkSession, path: str) -> None:
    system, where = _folder(spark, path)
    system.delete(where, True)


def swap_months(
    df: DataFrame, table: str, months: Iterable[int | str], partition: str = KEYS.period, fmt: str = "parquet",
    keep_old: bool = False,
) -> dict[int, str]:
    """Replace the listed months of a catalogued table in two steps, so that no reader meets half a replacement.

    First all rows are written to fresh folders that nobody reads. Only then does the catalog point the months there,
    which moves no data; if that fails on the way, the months already moved are pointed back. Whatever fails, every
    month is whole, and before the second step all of them are as they were. A listed month without rows is
    cleared; a row of any other month is an error. Since nothing is overwritten, ``df`` may read the same months.
    Old folders go last, unless ``keep_old``. Returns the new folders; path readers use ``partition_location``.
    """
    spark = df.sparkSession
    listed = sorted({int(m) for m in months})
    columns = [c for c in df.columns if c.lower() != partition.lower()] + [partition]
    if [c.lower() for c in spark.table(table).columns] != [c.lower() for c in columns]:
        raise ValueError(f"columns of {table} differ from the columns to write")
    fresh = f"{_table_location(spark, table)}/_swap/{uuid.uuid4().hex}"
    written = Observation()
    counts = (F.count_if(F.col(partition) == m).alias(f"m{m}") for m in listed)
    rows = _listed_only(df.select(*columns), partition, listed).observe(written, F.count(F.lit(1)).alias("all"), *counts)
    rows.write.format(fmt).option("compression", "snappy").partitionBy(partition).save(fresh)

    before = {m: partition_location(spark, table, m, partition) for m in listed}
    filled = {m: f"{fresh}/{partition}={m}" for m in listed if written.get.get(f"m{m}")}
    moved: list[int] = []
    try:
        for m in listed:
            if m in filled or before[m]:
                folder = f"{fresh}/{partition}={m}"
                system, where = _folder(spark, folder)
                system.mkdirs(where)  # a cleared month gets an empty one
                moved.append(m)
                _point(spark, table, partition, m, folder, before[m] is not None)
    except BaseException:
        for m in reversed(moved):
            _point(spark, table, partition, m, before[m], True)
        raise
    for m in listed:
        if m not in filled and before[m]:
            _point(spark, table, partition, m, None, True)
    spark.catalog.refreshTable(table)
    if not keep_old:
        for old in before.values():
            if old:
                delete_folder(spark, old)
    return filled


def stage_path(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write to a shared path and read back, which also cuts the lineage."""
    df.write.format(fmt).mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def stage_table(
    df: DataFrame, name: str, partition: str | None = KEYS.period, path: str | None = None, fmt: str = "parquet",
    bucket_by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    """Write to a stage table (external when ``path`` is given, else managed) and read it back.

    With ``bucket_by`` the rows are stored by those columns, in ``buckets`` (the session's shuffle partitions by default)
    and sorted, so that joins and aggregates on them read the table without a shuffle. Rows are brought together by
    bucket first, so each bucket of a month is one file.
    """
    if bucket_by:
        buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(buckets, *bucket_by)
    writer = df.write.format(fmt).mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if partition is not None:
        writer = writer.partitionBy(partition)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop_stage(spark: SparkSession, *names: str, folders: Iterable[str] = ()) -> None:
    """Drop stage tables, and the ``folders`` of external ones or of tables that the catalog has forgotten."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in folders:
        delete_folder(spark, path)


def materialise(df: DataFrame, durable: bool = False) -> DataFrame:
    """Compute once and reuse.

    By default the rows are cached; lost blocks are recomputed. ``durable`` writes a checkpoint to the
    shared folder of the session, for long plans that must survive lost executors without recomputing.
    """
    if not durable:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return df.checkpoint()

"""Late data: only the customers whose input rows changed are computed again.

Next to a matrix a table keeps one digest per customer and analysis month, over everything that the customer's row
follows from: its raw rows in the window, the ids that they resolve to, the months that count as present, and the
measures. A later run digests the window again, which moves ids and digests but no measures, and compares. Raw rows of the
customers that differ are then found by their ids and go through the same plan as a whole month does; their matrix rows
replace the old ones in the month's partition, by a swap of folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmatrix.config import LOOK_BACK, Channel, KeyColumns
from featmatrix.functions.periods import shift_month
from featmatrix.operators.identity import resolve_identity
from featmatrix.operators.joins import broadcast_if_small
from featmatrix.operators.trailing import present_ordinals
from featmatrix.plans.matrix import build_matrix
from featmatrix.plans.pipeline import RunConfig, configure_session, matrix_for, present_months
from featmatrix.sources.sinks import materialise, swap_months, write_matrix
from featmatrix.sources.tables import read_months, read_table

DIGESTS = "_digests"
_SUMS = ("digest_1", "digest_2")


@dataclass(frozen=True)
class Refreshed:
    """Customers of a month that were computed again, that left, and in all. ``whole``: there was nothing to compare with."""

    changed: int
    gone: int
    customers: int
    whole: bool


def _sums(*values: Column | str) -> list[Column]:
    """Two 64-bit hashes, summed: the sum does not depend on the order of rows, and repeated rows do not cancel out."""
    hashed = (F.xxhash64(F.lit(salt), *values).cast("decimal(38,0)") for salt in (1, 2))
    return [F.sum(h).alias(n) for h, n in zip(hashed, _SUMS)]


def narrow_rows(concept: DataFrame, identity: DataFrame, channel: Channel, month: int, duplicates: str = "raise") -> DataFrame:
    """Raw ids and months of the window with the ids that they resolve to, and digests in place of the measures."""
    keys = channel.keys
    measures = [m.name for m in channel.measures]
    window = read_months(concept, shift_month(month, -LOOK_BACK), month, [keys.period, *keys.ids, *measures], keys.period)
    combined = window.groupBy(keys.period, *keys.ids).agg(*_sums(*measures))
    raw = combined.select("*", *(F.col(k).alias(f"_raw_{i}") for i, k in enumerate(keys.ids)))
    snapshot = identity.where(F.col(keys.period) == int(month)).select(keys.client, keys.party, keys.concept)
    resolved = resolve_identity(raw, snapshot, channel.trim, duplicates, None, keys)
    written = F.trim(keys.party) if channel.trim_output_party else F.col(keys.party)
    named = F.col(keys.client).isNotNull() & F.col(keys.party).isNotNull()
    return resolved.where(named).withColumn("_party", F.col(keys.party)).withColumn(keys.party, written)


def customer_digests(narrow: DataFrame, channel: Channel, ordinals: Sequence[int]) -> DataFrame:
    """One row per customer, by the ids that the matrix shows: what its matrix row follows from, as two numbers."""
    keys = channel.keys
    salt = F.lit(repr((tuple(ordinals), [m.name for m in channel.measures])))
    return narrow.groupBy(*keys.ids).agg(*_sums(salt, F.col(keys.period), "_party", "_raw_0", "_raw_1", *_SUMS))


def changed_customers(now: DataFrame, stored: DataFrame, keys: KeyColumns) -> DataFrame:
    """Customers that are new, different or gone (``gone``), by their digests."""
    sides = [d.select(*keys.ids, F.struct(*_SUMS).alias(n)) for d, n in ((now, "_now"), (stored, "_then"))]
    both = sides[0].join(sides[1], list(keys.ids), "full")
    return both.where(~F.col("_now").eqNullSafe(F.col("_then"))).select(*keys.ids, F.col("_now").isNull().alias("gone"))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)))


def rows_of_customers(concept: DataFrame, narrow: DataFrame, changed: DataFrame, channel: Channel, broadcast_rows: int | None) -> DataFrame:
    """Raw rows that resolve to one of the customers, found by their raw ids."""
    keys = channel.keys
    ids = narrow.join(changed.where("not gone"), list(keys.ids), "left_semi").select("_raw_0", "_raw_1").distinct()
    return concept.join(broadcast_if_small(ids, broadcast_rows), _same(keys.ids, ("_raw_0", "_raw_1")), "left_semi")


def digest_table(cfg: RunConfig) -> str:
    return cfg.target + DIGESTS


def _write_digests(spark: SparkSession, cfg: RunConfig, digests: DataFrame, month: int) -> None:
    table, period = digest_table(cfg), cfg.channel.keys.period
    rows = digests.select(*cfg.channel.keys.ids, *_SUMS, F.lit(month).alias(period))
    if spark.catalog.tableExists(table):
        swap_months(rows, table, [month], period)
    else:
        write_matrix(rows, table, period)


def refresh_month(spark: SparkSession, cfg: RunConfig, month: int | str, broadcast_rows: int | None = 1_000_000) -> Refreshed:
    """Bring one month of the matrix up to date with its input; equal to running the whole month again.

    Rows of customers that did not change keep the routine date and record time of their own run. A month that has
    no digests yet is computed whole. Ids of changed customers are broadcast if they are counted to be few.
    Digests are written last: after a failure the same customers are found again.
    """
    configure_session(spark)
    month, keys = int(month), cfg.channel.keys
    concept, identity = (read_table(spark, cfg.namespace, t) for t in (cfg.concept_table, cfg.identity_table))
    if not cfg.drop_null_keys:
        raise ValueError("customers without an identity cannot be told apart; drop them to refresh a month")
    present = present_months(spark, cfg, [month])
    ordinals = present_ordinals(present or (), month, cfg.periods)
    narrow = materialise(narrow_rows(concept, identity, cfg.channel, month, cfg.duplicates))
    digests = materialise(customer_digests(narrow, cfg.channel, ordinals))
    customers = digests.count()
    known = spark.catalog.tableExists(cfg.target) and spark.catalog.tableExists(digest_table(cfg))
    stored = spark.table(digest_table(cfg)).where(F.col(keys.period) == month) if known else None
    try:
        if stored is None or stored.limit(1).count() == 0:
            matrix = matrix_for(spark, cfg, [month], present)
            if spark.catalog.tableExists(cfg.target):
                swap_months(matrix, cfg.target, [month], keys.period)
            else:
                write_matrix(matrix, cfg.target, keys.period)
            _write_digests(spark, cfg, digests, month)
            return Refreshed(customers, 0, customers, True)

        changed = materialise(changed_customers(digests, stored, keys))
        count = {r.gone: r["count"] for r in changed.groupBy("gone").count().collect()}
        if count:
            few = rows_of_customers(concept, narrow, changed, cfg.channel, broadcast_rows)
            again = build_matrix(
                few, identity, cfg.channel, [month], cfg.run_date, cfg.ts, periods=cfg.periods, present=present or (),
                partitions=cfg.partitions, duplicates=cfg.duplicates,
            )
            old = spark.table(cfg.target).where(F.col(keys.period) == month)
            left = old.join(broadcast_if_small(changed.drop("gone"), broadcast_rows), list(keys.ids), "left_anti")
            swap_months(left.select(*again.columns).unionByName(again), cfg.target, [month], keys.period)
            _write_digests(spark, cfg, digests, month)
        changed.unpersist()
        return Refreshed(count.get(False, 0), count.get(True, 0), customers, False)
    finally:
        digests.unpersist()
        narrow.unpersist()


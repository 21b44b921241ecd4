"""Proof that two versions of a matrix are the same: schema, counts, keys, cells, hashes, totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmatrix.config import KEYS

HASH_SPREAD = 64
#: Size of the sketch of distinct keys in a profile, as a power of two.
KEY_SKETCH = 14


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that differ in presence, position or type; empty for equal schemas."""
    left = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(a.schema.fields)}
    right = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(b.schema.fields)}
    rows = []
    for name in [*left, *(n for n in right if n not in left)]:
        (pa, ta), (pb, tb) = left.get(name, (None, None)), right.get(name, (None, None))
        if (pa, ta) != (pb, tb):
            rows.append((name, pa, pb, ta, tb))
    schema = "column_name string, position_a int, position_b int, type_a string, type_b string"
    return a.sparkSession.createDataFrame(rows, schema)


def count_diff(a: DataFrame, b: DataFrame, by: Sequence[str] = (KEYS.period,)) -> DataFrame:
    """Row counts of both sides per month, and their difference."""
    sides = [d.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "rows_a"), (b, "rows_b"))]
    joined = sides[0].join(sides[1], list(by), "full").na.fill(0, ["rows_a", "rows_b"])
    return joined.withColumn("rows_diff", F.col("rows_a") - F.col("rows_b"))


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS.matrix) -> DataFrame:
    """Keys found on one side only. NULL keys compare as equal."""
    sides = [d.select(*keys, F.lit(s).alias("_side")) for d, s in ((a, 1), (b, 2))]
    seen = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.bit_or("_side").alias("_side"))
    named = F.when(F.col("_side") == 1, F.lit("only_a")).otherwise(F.lit("only_b"))
    return seen.where("_side < 3").select(*keys, named.alias("side"))


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _is_exact(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.IntegralType, T.DecimalType))


def _exact_type(x: T.DataType, y: T.DataType) -> str:
    """A decimal type that holds both columns' values as they are."""
    scale = max(getattr(t, "scale", 0) for t in (x, y))
    return f"decimal(38,{scale})"


class PairedColumns:
    """The columns that two tables share besides their keys, by how they are compared: pairs of fields."""

    def __init__(self, a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> None:
        named = {f.name.lower(): f for f in b.schema.fields}
        wanted = {c.lower() for c in (columns or a.columns)} - {k.lower() for k in keys}
        pairs = [(f, named[f.name.lower()]) for f in a.schema.fields if f.name.lower() in wanted and f.name.lower() in named]
        if not pairs:
            raise ValueError("the two sides share no columns besides the keys")
        self.exact = [(x, y) for x, y in pairs if _is_exact(x) and _is_exact(y)]
        self.numbers = [(x, y) for x, y in pairs if _is_number(x) and _is_number(y) and not (_is_exact(x) and _is_exact(y))]
        self.texts = [(x, y) for x, y in pairs if not (_is_number(x) and _is_number(y))]

    @staticmethod
    def _col(pair: tuple, which: int) -> Column:
        return F.col(f"`{pair[which].name}`")

    def exact_values(self, which: int) -> list[Column]:
        return [self._col(p, which).cast(_exact_type(p[0].dataType, p[1].dataType)).cast("string") for p in self.exact]

    def number_values(self, which: int) -> list[Column]:
        return [self._col(p, which).cast("double") for p in self.numbers]

    def text_values(self, which: int) -> list[Column]:
        return [F.trim(self._col(p, which).cast("string")) for p in self.texts]

    def normal(self, which: int) -> list[Column]:
        """Values of one side in the form that both sides share; each NULL is followed by a mark of its own."""
        values = [*self.exact_values(which), *self.number_values(which), *self.text_values(which)]
        return [x for v in values for x in (v, v.isNull())]


def cell_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS.matrix, eps: float = 0.0,
    eps_by_column: Mapping[str, float] | None = None, ignore_case: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Cells that differ on shared keys: numbers beyond epsilon, texts after trimming.

    Columns are matched without regard to case. Integers and decimals are compared as they are, not as doubles.
    Keys of NULL match each other; a key that one side has twice is an error. Both sides go through one exchange by
    key, cells are compared inside the row, as arrays, and only differing ones are exploded, so equal matrices
    produce no intermediate rows and wide ones no wide expressions.
    """
    limits = eps_by_column or {}
    pairs = PairedColumns(a, b, keys, columns)
    exact, numbers, texts = pairs.exact, pairs.numbers, pairs.texts

    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select(
            *keys,
            F.lit(which).alias("_side"),
            F.array(*pairs.number_values(which)).cast("array<double>").alias("_n"),
            F.array(*pairs.text_values(which)).cast("array<string>").alias("_t"),
            F.array(*pairs.exact_values(which)).cast("array<string>").alias("_e"),
        )

    def names(group: list) -> Column:
        return F.array(*(F.lit(x.name) for x, _ in group)).cast("array<string>")

    def allowed(group: list) -> Column:
        return F.array(*(F.lit(float(limits.get(x.name, eps))) for x, _ in group)).cast("array<double>")

    both = side(a, 0).unionByName(side(b, 1)).groupBy(*keys)
    repeated = F.raise_error(F.lit("a key occurs more than once on one side")).cast("boolean")
    sides = {
        f"_{kind}{tag}": F.expr(f"any_value(_{kind}) filter (where _side = {which})")
        for which, tag in enumerate("ab")
        for kind in "nte"
    }
    counts = [F.count_if(F.col("_side") == which).alias(f"_c{tag}") for which, tag in enumerate("ab")]
    met = both.agg(*counts, *(c.alias(n) for n, c in sides.items()))
    met = met.where(F.when((F.col("_ca") > 1) | (F.col("_cb") > 1), repeated).otherwise((F.col("_ca") == 1) & (F.col("_cb") == 1)))

    number_cells = F.arrays_zip(
        names(numbers).alias("name"), F.col("_na").alias("x"), F.col("_nb").alias("y"), allowed(numbers).alias("eps")
    )
    exact_cells = F.arrays_zip(
        names(exact).alias("name"), F.col("_ea").alias("x"), F.col("_eb").alias("y"), allowed(exact).alias("eps")
    )
    text_cells = F.arrays_zip(names(texts).alias("name"), F.col("_ta").alias("x"), F.col("_tb").alias("y"))

    def number_differs(c: Column) -> Column:
        close = F.coalesce(F.abs(c["x"] - c["y"]) <= c["eps"], F.lit(False))
        return ~(c["x"].eqNullSafe(c["y"]) | close)

    def apart(c: Column) -> Column:
        """Exact difference of two numbers written as text, as far as a double holds it."""
        whole = lambda x: x.cast("decimal(38,6)")
        return F.abs(whole(c["x"]) - whole(c["y"])).cast("double")

    def exact_differs(c: Column) -> Column:
        close = (c["eps"] > 0) & F.coalesce(apart(c) <= c["eps"], F.lit(False))
        return ~(c["x"].eqNullSafe(c["y"]) | close)

    def text_differs(c: Column) -> Column:
        x, y = (F.lower(c["x"]), F.lower(c["y"])) if ignore_case else (c["x"], c["y"])
        return ~x.eqNullSafe(y)

    def cell(c: Column, diff: Column) -> Column:
        return F.struct(
            c["name"].alias("column_name"), c["x"].cast("string").alias("value_a"), c["y"].cast("string").alias("value_b"),
            diff.alias("abs_diff"),
        )

    found = F.concat(
        F.transform(F.filter(number_cells, number_differs), lambda c: cell(c, F.abs(c["x"] - c["y"]))),
        F.transform(F.filter(exact_cells, exact_differs), lambda c: cell(c, apart(c))),
        F.transform(F.filter(text_cells, text_differs), lambda c: cell(c, F.lit(None).cast("double"))),
    )
    return met.select(*keys, F.explode(found).alias("_cell")).select(*keys, "_cell.*")


def _digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the values as text, each with its length before it; NULL has a mark of its own."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = KEYS.matrix) -> DataFrame:
    """SHA-256 per row over the given columns; NULL differs from every text, and values cannot run together."""
    cols = columns or [c for c in df.columns if c not in keys]
    return df.select(*keys, _digest(cols).alias("row_hash"))


def table_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and a hash of the whole table that does not depend on row order: the sum of row-hash prefixes."""
    value = F.conv(F.substring(_digest(columns or df.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(value).cast("decimal(38,0)").alias("table_hash"))


def control_totals(
    df: DataFrame, month: int | str, measure: str, period: str = KEYS.period, client: str = KEYS.client,
    analysis: str = KEYS.analysis,
) -> DataFrame:
    return df.where(F.col(period) == int(month)).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct(client).alias("distinct_clients"),
        F.min(analysis).alias("min_month"),
        F.max(analysis).alias("max_month"),
        F.sum(measure).alias("measure_sum"),
    )


def metric_sums(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS.matrix) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).alias(f"sum_{c}") for c in columns))


def sample_keys(df: DataFrame, keys: Sequence[str] = KEYS.matrix, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` keys chosen by a seeded SHA-256 of the key: the same keys on every run.

    A bottom-k by hash: every task keeps the keys with its ``n`` smallest hashes before anything is shuffled, then a
    few tasks do, then one. Keys are never all sorted or made distinct.
    """
    hashed = df.select(*keys).withColumn("_seed", F.lit(seed)).withColumn("_order", _digest([*keys, "_seed"])).drop("_seed")
    spread = hashed.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(HASH_SPREAD)))
    smallest = F.dense_rank().over(Window.partitionBy("_part").orderBy("_order"))
    leaders = spread.withColumn("_rank", smallest).where(F.col("_rank") <= n).select("_order", *keys).distinct()
    return leaders.orderBy("_order", *keys).limit(n).select(*keys)


def sample_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS.matrix, n: int = 100, seed: int = 42, eps: float = 0.0
) -> DataFrame:
    """Differences of a sample of the keys of both sides: cells, and keys that one side lacks.

    A key of one side only comes as column ``(row)`` with the value ``present`` on that side.
    """
    chosen = sample_keys(a.select(*keys).unionByName(b.select(*keys)), keys, n, seed)
    renamed = F.broadcast(chosen.toDF(*(f"_k{i}" for i in range(len(keys)))))  # n rows by construction

    def sampled(df: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return df.join(renamed, same, "left_semi")

    one, two = sampled(a), sampled(b)
    present = lambda side: F.when(F.col("side") == side, F.lit("present"))
    missing = key_diff(one, two, keys).select(
        *keys, F.lit("(row)").alias("column_name"), present("only_a").alias("value_a"),
        present("only_b").alias("value_b"), F.lit(None).cast("double").alias("abs_diff"),
    )
    return cell_diff(one, two, keys, eps).unionByName(missing)


def diff_summary(cells: DataFrame) -> DataFrame:
    """Distribution of the differences per column; the median is exact up to ten thousand distinct differences.

    ``sketches`` has the form that merges over months and states its error.
    """
    return cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.max("abs_diff").alias("max_diff"),
        F.avg("abs_diff").alias("mean_diff"),
        F.percentile_approx("abs_diff", 0.5, 10_000).alias("median_diff"),
    )


def top_diffs(cells: DataFrame, n: int, keys: Sequence[str] = KEYS.matrix) -> DataFrame:
    """The ``n`` largest differences of each column, in two steps so that no column meets one task whole."""
    order = [F.col("abs_diff").desc_nulls_last(), *keys]
    part = F.pmod(F.xxhash64(*keys), F.lit(HASH_SPREAD))
    local = Window.partitionBy("column_name", "_part").orderBy(*order)
    total = Window.partitionBy("column_name").orderBy(*order)
    leaders = cells.withColumn("_part", part).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    ranked = leaders.withColumn("diff_rank", F.row_number().over(total)).where(F.col("diff_rank") <= n)
    return ranked.drop("_part", "_r")


def profile(df: DataFrame, keys: Sequence[str] = KEYS.matrix, key_count: str = "exact") -> DataFrame:
    """One row per column: rows, distinct keys of the stage, NULL count and sum.

    Cells are aggregated by column name and combine map-side to one row per column and task, so a wide
    table needs no wide aggregate. ``key_count`` is "exact", by a subquery over the keys alone, or "sketch", which counts
    them in the same pass with the error that ``sketches.key_error`` states.
    """
    if key_count not in ("exact", "sketch"):
        raise ValueError(f"key_count must be exact or sketch, not {key_count!r}")
    fields = [f for f in df.schema.fields if f.name not in keys]
    numbers = [F.col(f.name).cast("double") if _is_number(f) else F.lit(None).cast("double") for f in fields]
    names, empty, key = [F.lit(f.name) for f in fields], [F.col(f.name).isNull() for f in fields], F.lit(None).cast("long")
    if key_count == "sketch":  # one more cell per row, with the key and without a name
        names, empty, numbers = [*names, F.lit(None)], [*empty, F.lit(False)], [*numbers, F.lit(None).cast("double")]
        key = F.xxhash64(*keys)
    cells = F.arrays_zip(
        F.array(*names).alias("column_name"), F.array(*empty).alias("empty"), F.array(*numbers).alias("number"),
        F.array(*[F.lit(None).cast("long")] * len(fields), *([key] if key_count == "sketch" else [])).alias("key"),
    )
    measures = [F.count(F.lit(1)).alias("row_count"), F.count_if("empty").alias("null_count"), F.sum("number").alias("total")]
    if key_count == "sketch":
        measures.append(F.hll_sketch_agg("key", KEY_SKETCH).alias("sketch"))
    columns = df.select(F.inline(cells)).groupBy("column_name").agg(*measures)
    if key_count == "sketch":
        counted = F.when(F.col("column_name").isNull(), F.hll_sketch_estimate("sketch"))
        everywhere = columns.withColumn("key_count", F.max(counted).over(Window.partitionBy(F.lit(1))))  # one row per column
        columns = everywhere.where("column_name is not null")
        keys_of = F.col("key_count")
    else:
        keys_of = df.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    return columns.select("row_count", keys_of.alias("key_count"), "column_name", "null_count", "total")

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query
is built and written to Spark's noop sink once; a small untimed query warms the session up.

    python bench.py [query ...]     the headline queries, or the named ones
    python bench.py --skew [N]      a generated panel of N customers (default 20 000) in which a third of all rows are
                                    identical and anonymous: one analysis month, and three months in one job
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from conformance.queries import QUERIES  # noqa: E402
from featmatrix.config import ANONYMOUS_ID, UNKNOWN_CLIENT  # noqa: E402
from featmatrix.functions.periods import shift_month  # noqa: E402
from featmatrix.plans.channels import agent_channel  # noqa: E402
from featmatrix.plans.matrix import build_matrix  # noqa: E402
from featmatrix.plans.pipeline import configure_session  # noqa: E402

HEADLINE = (
    "src_months_scan",
    "joi_identity",
    "joi_densify",
    "agg_consolidate",
    "agg_frequency",
    "agg_mean_last",
    "agg_first_last_two",
    "agg_ind_two",
    "win_trailing_avg",
    "win_trailing_prev_blocks",
    "der_growth",
    "der_min_gate",
    "par_keys",
    "par_cells",
    "par_profile",
    "pip_agent",
    "pip_atm",
    "pip_pos",
    "pip_backfill",
)


def skewed(spark: SparkSession, customers: int) -> dict[str, float]:
    """Seconds of the agent matrix over a generated panel with a hot anonymous party."""
    channel = agent_channel()
    names = [m.name for m in channel.measures]
    months = [int(shift_month(202412, -i)) for i in range(14)]
    values = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("double").alias(n) for i, n in enumerate(names)]
    party = F.lpad(F.col("id").cast("string"), 12, "0")
    known = spark.range(customers).select(
        F.explode(F.array(*map(F.lit, months))).alias("codmes"), F.concat(F.lit("U"), "id").alias("codunicocli"),
        party.alias("codinternocomputacional"), *values,
    )
    copies = spark.range(customers * len(months) // 2).select(
        F.lit(202412).alias("codmes"), F.lit(UNKNOWN_CLIENT).alias("codunicocli"),
        F.lit(ANONYMOUS_ID).alias("codinternocomputacional"), *(F.lit(1.0).alias(n) for n in names),
    )
    identity = spark.range(customers).select(
        F.explode(F.array(*map(F.lit, months))).alias("codmes"), F.concat(F.lit("U"), "id").alias("codunicocli"),
        party.alias("codinternocomputacional"), party.alias("codinternocomputacionalconcepto"),
    )
    times = {}
    for name, wanted in (("one_month", months[:1]), ("three_months_one_job", months[:3])):
        for turn in ("first", "second"):
            started = time.perf_counter()
            matrix = build_matrix(known.unionByName(copies), identity, channel, wanted, "2025-01-05", partitions=64)
            matrix.write.format("noop").mode("overwrite").save()
            times[f"{name}_{turn}"] = round(time.perf_counter() - started, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("featmatrix-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure_session(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()

    skew = sys.argv[1:2] == ["--skew"]
    names = () if skew else sys.argv[1:] or HEADLINE
    times = skewed(spark, int((sys.argv[2:] or [20_000])[0])) if skew else {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "skewed panel, total wall time" if skew else "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

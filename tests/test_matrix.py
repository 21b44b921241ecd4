from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from featmatrix.config import CTD, FLG, MTO, Channel, Measure
from featmatrix.operators.columns import classify
from featmatrix.plans.channels import agent_channel, atm_channel, pos_channel
from featmatrix.plans.matrix import build_features, build_matrix, expand_matrix, feature_types, matrix_specs

IDENTITY = "codmes int, codunicocli string, codinternocomputacional string, codinternocomputacionalconcepto string"
CONCEPT = "codmes int, codunicocli string, codinternocomputacional string, X_MTO_T double, X_CTD_T double, X_FLG_T int"
MEASURES = (Measure("X_MTO_T", MTO), Measure("X_CTD_T", CTD), Measure("X_FLG_T", FLG))


def tiny_channel(**changes) -> Channel:
    options = dict(
        name="tiny", target="tiny_matrix", prefix="X", measures=MEASURES, blocks=((MTO,), (CTD,)),
        with_previous=frozenset((MTO,)), trim="join", frequency_type="bigint",
    )
    return Channel(**{**options, **changes})


def hand_rows():
    rows = [
        ("A", 202412, 10.0, 2.0, 1), ("A", 202411, 20.0, 0.0, 0), ("A", 202409, 30.0, 1.0, 1), ("A", 202406, 60.0, 3.0, 1),
        ("B", 202403, -12.0, 1.0, 1),
    ]
    return rows + [("C", 202400 + m, 1.0, 1.0, 1) for m in range(1, 13)]


@pytest.fixture()
def concept(spark):
    return spark.createDataFrame([(m, f"U{c}", f"00000000000{c}", *v) for c, m, *v in hand_rows()], CONCEPT)


@pytest.fixture()
def identity(spark):
    return spark.createDataFrame([(202412, f"U{c}", f"00000000000{c}", f"00000000000{c}") for c in "ABC"], IDENTITY)


EXPECTED = {
    "mto_t_u1m": (10, 0, 1),
    "mto_t_prm_u3m": (10, 0, 1),
    "mto_t_prm_u6m": (10, 0, 1),
    "mto_t_prm_u9m": (13.333333, 0, 1),
    "mto_t_prm_u12": (10, -1, 1),
    "mto_t_prm_p3m": (10, 0, 1),
    "mto_t_prm_p6m": (10, -2, 1),
    "mto_t_p1m": (20, 0, 1),
    "mto_t_max_u3m": (20, 0, 1),
    "mto_t_max_u6m": (30, 0, 1),
    "mto_t_max_u9m": (60, 0, 1),
    "mto_t_max_u12": (60, 0, 1),
    "mto_t_min_u3m": (0, 0, 1),
    "mto_t_min_u12": (0, -12, 1),
    "mto_t_g6m": (1, 0, 1),
    "mto_t_g3m": (1, None, 1),
    "mto_t_g1m": (0.5, None, 1),
    "ctd_t_rec": (1, 10, 1),
    "ctd_t_frq_u3m": (1, 0, 3),
    "ctd_t_frq_u6m": (2, 0, 6),
    "ctd_t_frq_u9m": (3, 0, 9),
    "ctd_t_frq_u12": (3, 1, 12),
    "ctd_t_min_u3m": (0, 0, 1),
    "ctd_t_min_u12": (0, 0, 1),
    "flg_t_x3m_u3m": (0, 0, 1),
    "flg_t_x12_u12": (0, 0, 1),
    "flg_t_max_u12": (1, 1, 1),
    "flg_t_u1m": (1, 0, 1),
}


def test_hand_sized_panel(concept, identity):
    rows = {r.codunicocli: r for r in build_features(concept, identity, tiny_channel(), [202412]).collect()}
    assert set(rows) == {"UA", "UB", "UC"}
    for name, values in EXPECTED.items():
        for customer, value in zip("ABC", values):
            got = rows[f"U{customer}"][f"x_{name}"]
            assert (got is None) == (value is None), (name, customer)
            assert value is None or got == pytest.approx(value, abs=1e-6), (name, customer)


@pytest.mark.parametrize(
    ("channel", "width", "by_class"),
    [(pos_channel(), 1783, (25, 25, 25, 25)), (agent_channel(), 934, (13, 13, 16, 16)), (atm_channel(), 1129, (16, 16, 19, 19))],
)
def test_width_and_types(channel, width, by_class):
    types = feature_types(channel)
    assert len(types) + 8 == width
    assert tuple(Counter(m.cls for m in channel.measures)[c] for c in ("MTO", "TKT", "CTD", "FLG")) == by_class
    assert all((t == "int") == ("_FLG_" in n) for n, t in types.items())
    frequencies = {t for n, t in types.items() if "_FRQ_" in n}
    assert frequencies == {"double" if channel.name == "pos" else "bigint"}
    assert len({s.name for s in matrix_specs(channel)}) == len(matrix_specs(channel))


def test_output_order():
    pos = list(feature_types(pos_channel()))
    assert pos[0] == "POS_FLG_TRX_IG01_U1M" and pos[25:29] == [f"POS_FLG_TRX_IG01_MAX_{s}" for s in ("U3M", "U6M", "U9M", "U12")]
    assert pos[-1] == "POS_CTD_TRX_G46_G1M"
    agent = list(feature_types(agent_channel()))
    assert agent.index("CAN_TKT_TMO_AGT_PRM_U12") < agent.index("CAN_MTO_TMO_AGT_PRM_P6M")
    assert agent.index("CAN_FLG_TNM_AGT_U1M") == 1


def test_schema_of_the_final_projection(concept, identity):
    df = build_matrix(concept, identity, tiny_channel(), [202412], "2025-01-01", datetime(2025, 1, 1))
    types = dict(df.dtypes)
    assert df.columns[:5] == ["codunicocli", "codclaveunicocli", "codclavepartycli", "codinternocomputacional", "codmesanalisis"]
    assert df.columns[-3:] == ["fecrutina", "fecactualizacionregistro", "codmes"]
    assert df.columns[5:-3] == [n.lower() for n in feature_types(tiny_channel())]
    for name, sql_type in feature_types(tiny_channel()).items():
        assert types[name.lower()] == sql_type
    assert (types["fecrutina"], types["fecactualizacionregistro"], types["codmes"], types["codmesanalisis"]) == ("date", "timestamp", "int", "int")
    row = df.where("codunicocli = 'UA'").first()
    import hashlib

    assert row.codclavepartycli == hashlib.sha512(b"000100000000000A").hexdigest()
    assert row.codclaveunicocli == "UA"


def test_strict_flag_rewrites_other_values(spark, identity):
    rows = [(202412, "UA", "00000000000A", 1.0, 1.0, 2)]
    concept = spark.createDataFrame(rows, CONCEPT)
    plain = build_features(concept, identity, tiny_channel(), [202412]).first()
    strict = build_features(concept, identity, tiny_channel(strict_flag_u1m=True), [202412]).first()
    assert (plain.x_flg_t_u1m, strict.x_flg_t_u1m) == (2, 0)


def test_customers_without_identity(spark, concept, identity):
    stranger = spark.createDataFrame([(202410, "UZ", "00000000000Z", 1.0, 1.0, 1)], CONCEPT)
    both = concept.unionByName(stranger)
    names = lambda **o: {r.codunicocli for r in build_features(both, identity, tiny_channel(), [202412], **o).collect()}
    assert names() == {"UA", "UB", "UC"}
    assert names(drop_null_keys=False) == {"UA", "UB", "UC", None}


def test_months_of_lost_customers_still_count_as_present(spark, identity):
    """A month seen only for customers without an identity still lowers the means."""
    rows = [(202412, "UA", "00000000000A", 10.0, 1.0, 1), (202411, "UZ", "00000000000Z", 5.0, 1.0, 1)]
    got = build_features(spark.createDataFrame(rows, CONCEPT), identity, tiny_channel(), [202412]).first()
    assert got.x_mto_t_prm_u3m == 5.0


def test_missing_analysis_month(spark, concept, identity):
    with pytest.raises(ValueError, match="no rows for analysis month 202501"):
        build_features(concept, identity, tiny_channel(), [202501])


def test_several_months_equal_single_months(spark, concept, identity):
    """Also where the months present differ between the windows."""
    months = [202412, 202411, 202409, 202404]
    snapshots = identity
    for m in months[1:]:
        moved = identity.withColumn("codmes", F.lit(m))
        if m == 202411:
            moved = moved.where("codunicocli <> 'UB'").withColumn("codunicocli", F.concat("codunicocli", F.lit("x")))
        snapshots = snapshots.unionByName(moved)
    channel = tiny_channel()
    together = build_features(concept, snapshots, channel, months)
    ordered = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    singles = [row for m in months for row in ordered(build_features(concept, snapshots, channel, [m]))]
    assert ordered(together) == sorted(singles, key=repr) and len(singles) >= 10


RULED = tuple(Measure(n, MTO) for n in ("X_MTO_T", "X_MTO_ANTMAX_T", "X_MTO_ANTMIN_T", "X_MTO_U")) + (Measure("X_CTD_T", CTD), Measure("X_FLG_T", FLG))


def moving_panel(spark, seed=5, customers=40, months=tuple(range(202301, 202313))):
    """Customers that merge, split, go missing and are anonymous, in a panel with NULLs and repeated rows."""
    import random

    rnd = random.Random(seed)
    rows = [
        (m, rnd.choice([f"U{c}", f"U{c // 2}", "U1"]), rnd.choice([f"P{c}", f"P{c}", "."]),
         *(rnd.choice([None, float(rnd.randint(-9, 9))]) for _ in range(5)), rnd.choice([None, 0, 1]))
        for m in months for c in range(customers) for _ in range(rnd.choice([0, 1, 1, 2]))
    ]
    schema = "codmes int, codunicocli string, codinternocomputacional string, " + ", ".join(f"{m.name} double" for m in RULED[:-1])
    ids = [
        (m, f"U{c if rnd.random() < 0.7 else c // 3}", f"P{c}", f"P{c if rnd.random() < 0.8 else c // 2}")
        for m in months for c in range(customers) if rnd.random() < 0.95
    ]
    return spark.createDataFrame(rows, schema + ", X_FLG_T int"), spark.createDataFrame(ids, IDENTITY)


@pytest.mark.parametrize(("span", "duplicates"), [(24, "raise"), (3, "raise"), (24, "multiply")])
def test_sliding_months_equal_single_months(spark, monkeypatch, span, duplicates):
    """Identities change between the snapshots, so months have several states that merge by every rule."""
    from featmatrix.plans import matrix

    monkeypatch.setattr(matrix, "SPAN_MONTHS", span)
    concept, identity = moving_panel(spark)
    if duplicates == "multiply":
        identity = identity.unionByName(identity.where("codinternocomputacional like '%3'").withColumn("codunicocli", F.lit("U3")))
    channel = tiny_channel(measures=RULED)
    months = [202312, 202311, 202308, 202305]
    ordered = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    together = ordered(build_features(concept, identity, channel, months, duplicates=duplicates, drop_null_keys=False))
    singles = [row for m in months for row in ordered(build_features(concept, identity, channel, [m], duplicates=duplicates, drop_null_keys=False))]
    assert together == sorted(singles, key=repr) and len(singles) > 60


def test_a_row_is_looked_up_once_and_copied_per_different_answer_only(spark):
    from featmatrix.operators.identity import analysis_bits, resolve_spans
    from featmatrix.plans.sliding import _window_bits, month_states

    concept, identity = moving_panel(spark)
    months = [202307, 202308, 202309, 202310, 202311, 202312]
    bits = analysis_bits(months)
    stable = identity.where("codmes = 202312").drop("codmes")
    same = stable.crossJoin(spark.createDataFrame([(m,) for m in months], "codmes int"))
    for snapshots, most in ((same, 1), (identity, 6)):
        named = snapshots.withColumnRenamed("codmes", "codmesanalisis")
        spans = resolve_spans(concept, named, bits, _window_bits(F.col("codmes"), bits), "join")
        assert (spans.count() == concept.count()) if most == 1 else concept.count() < spans.count() < 4 * concept.count()
    states = month_states(concept, same, tiny_channel(measures=RULED), months)
    distinct = states.select("codmes", "codunicocli", "codinternocomputacional").distinct().count()
    assert states.count() == distinct  # one state for each identity and month
    with pytest.raises(ValueError, match="62"):
        analysis_bits(range(1, 64))


def test_sliding_plan_has_the_exchanges_of_one_month(spark, plan_of):
    """Lookup, consolidation, slots: as many exchanges of the panel for twelve analysis months as for one."""
    concept, identity = moving_panel(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            plan_of(build_features(concept, identity, tiny_channel(measures=RULED), months, present=range(202301, 202313)), "simple")
            for months in ([202312], [202312, 202311, 202310])
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    panel = [[x for x in p.splitlines() if "Exchange hashpartitioning(codunicocli" in x or "Exchange hashpartitioning(_lookup_key" in x] for p in plans]
    assert plans[1].count("Scan ExistingRDD[codmes") <= 3 + plans[0].count("Scan ExistingRDD[codmes")
    assert panel[0] and "Window" not in plans[1] and "Python" not in plans[1]


def test_classify():
    got = classify(["POS_MTO_TRX_G01", "POS_FLG_TRX_G01", "CODMES", "CAN_MTO_X"], "POS")
    assert got == (Measure("POS_MTO_TRX_G01", "MTO"), Measure("POS_FLG_TRX_G01", "FLG"))


def test_bad_channel():
    with pytest.raises(ValueError, match="trim"):
        tiny_channel(trim="left")
    with pytest.raises(ValueError, match="no measures"):
        tiny_channel(measures=())


def test_full_width_plan_is_small(spark, plan_of):
    """Three exchanges of the panel, no join against itself, no window, no Python worker."""
    channel = pos_channel()
    schema = ", ".join(f"`{m.name}` double" for m in channel.measures)
    concept = spark.createDataFrame([], f"codmes int, codunicocli string, codinternocomputacional string, {schema}")
    from featmatrix.plans.matrix import consolidated_panel

    identity = spark.createDataFrame([], IDENTITY)
    rows = consolidated_panel(concept, identity, channel, 202412)
    df = expand_matrix(rows, channel, tuple(range(1, 13)), 202412)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(df, "simple")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    wide = [line for line in exchanges if "_lookup_key" in line or "codinternocomputacional" in line]
    assert len(df.columns) == 1775 + 3
    assert 3 <= len(wide) and len(exchanges) <= 9
    for bad in ("Window", "Cartesian", "NestedLoop", "Python", "Arrow"):
        assert bad not in plan

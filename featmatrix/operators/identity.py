"""Re-keying a monthly panel to each customer's current identity, and consolidating it.

Rules, for a panel row (client, party) and the identity snapshot of the analysis month:

* a known party (trimmed id not ".") takes the snapshot's client, NULL when it is not in the snapshot;
* any other row, also one with a NULL party, keeps its own client;
* a client that is not the unknown client then takes its base party (the greatest concept id of that
  client in the snapshot), or a padded "." when it has none;
* the unknown client, or a NULL client, keeps the party found in the first step.

A row needs one lookup only, by party or by client, because the base party of a snapshot row can be
attached to the snapshot beforehand. So the panel is shuffled once for both joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.config import ANONYMOUS_ID, KEYS, PARTY_WIDTH, UNKNOWN_CLIENT, KeyColumns
from featmatrix.operators.joins import broadcast_if_small, keyed_for_lookup, lookup_join

_BY_PARTY, _BY_CLIENT = "P", "C"

# Fixed rule of the data model: how a measure is consolidated, by a text in its name.
MAX_TEXTS = ("_FLG_", "_ANTMAX_", "_TIP_", "_CTDDIA_")
MIN_TEXTS = ("_ANTMIN_",)


def base_client(identity: DataFrame, by: Sequence[str] = (), keys: KeyColumns = KEYS) -> DataFrame:
    """Base party of every client: the greatest concept id, per month."""
    return identity.groupBy(*by, keys.client).agg(F.max(keys.concept).alias("party_last"))


def _not_unknown(client: Column) -> Column:
    return F.trim(client) != UNKNOWN_CLIENT


def _trims(trim: str):
    if trim not in ("group", "join", "none"):
        raise ValueError(f"trim must be group, join or none, not {trim!r}")
    keep = lambda c: c
    return (F.trim if trim == "join" else keep), (F.trim if trim == "group" else keep)


def _tagged(tag: str, by: Sequence[str], key: Column) -> Column:
    """Lookup key as text: kind, analysis month if any, id. NULL when the id is NULL."""
    return F.concat(F.lit(tag), *(F.concat(F.col(c).cast("string"), F.lit(":")) for c in by), key)


def _unique_party(snap: DataFrame, by: Sequence[str], party: str) -> DataFrame:
    """Fail when a party occurs twice, within the aggregation that the join needs anyway."""
    others = [c for c in snap.columns if c not in (*by, party)]
    counted = snap.groupBy(*by, party).agg(F.count(F.lit(1)).alias("_n"), *(F.max(c).alias(c) for c in others))
    message = F.concat(F.lit("party id repeated in the identity snapshot: "), F.coalesce(party, F.lit("NULL")))
    first = others[0]
    return counted.withColumn(first, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(first))).drop("_n")


def identity_lookup(
    identity: DataFrame, trim: str, by: Sequence[str] = (), duplicates: str = "raise", keys: KeyColumns = KEYS
) -> DataFrame:
    """One table that answers both lookups: ``lookup``, ``new_client``, ``new_party``.

    With ``by`` (the analysis month) the answers of all months of a key are one row: ``lookup`` and an array
    ``answers`` of (month, new_client, new_party), so that a panel row is looked up once for all its months.
    """
    at_join, at_group = _trims(trim)
    padded = F.rpad(F.lit(ANONYMOUS_ID), PARTY_WIDTH, " ")
    base = base_client(identity, by, keys).where(_not_unknown(F.col(keys.client)))
    by_client = base.select(
        *by,
        _tagged(_BY_CLIENT, (), F.col(keys.client)).alias("lookup"),
        F.lit(None).cast("string").alias("new_client"),
        F.coalesce(at_group(F.col("party_last")), padded).alias("new_party"),
    )
    snap = identity.select(
        *by, at_join(F.col(keys.party)).alias(keys.party), F.col(keys.client), F.col(keys.concept)
    ).where(F.trim(keys.party) != ANONYMOUS_ID)
    if duplicates == "raise":
        # the client column carries the check, and every use of the lookup reads it
        snap = _unique_party(snap, by, keys.party)
    elif duplicates != "multiply":
        raise ValueError(f"duplicates must be raise or multiply, not {duplicates!r}")
    client_key = F.when(_not_unknown(F.col(keys.client)), _tagged(_BY_CLIENT, by, F.col(keys.client)))
    base_keyed = base.select(_tagged(_BY_CLIENT, by, F.col(keys.client)).alias("base_key"), "party_last")
    by_party = lookup_join(snap, base_keyed, client_key, "base_key").select(
        *by,
        _tagged(_BY_PARTY, (), F.col(keys.party)).alias("lookup"),
        at_group(F.col(keys.client)).alias("new_client"),
        F.when(_not_unknown(F.col(keys.client)), F.coalesce(at_group(F.col("party_last")), padded))
        .otherwise(at_group(F.col(keys.concept)))
        .alias("new_party"),
    )
    both = by_party.unionByName(by_client)
    if not by:
        return both
    answer = F.struct(F.col(by[0]).alias("month"), "new_client", "new_party")
    return both.groupBy("lookup").agg(F.collect_list(answer).alias("answers"))  # one per month


def resolve_identity(
    panel: DataFrame,
    identity: DataFrame,
    trim: str = "group",
    duplicates: str = "raise",
    broadcast_rows: int | None = None,
    keys: KeyColumns = KEYS,
) -> DataFrame:
    """Panel with client and party replaced by the ones valid in the snapshot.

    ``duplicates='multiply'`` repeats a panel row per match instead of failing.
    """
    ids = _Ids(trim, keys)
    table = broadcast_if_small(identity_lookup(identity, trim, (), duplicates, keys), broadcast_rows)
    found = lookup_join(panel, table, ids.lookup, "lookup")
    rest = F.expr(f"* except ({keys.client}, {keys.party}, new_client, new_party)")
    return found.select(rest, *ids.replaced(F.col("new_client"), F.col("new_party")))


def with_lookup_key(panel: DataFrame, trim: str = "group", keys: KeyColumns = KEYS) -> DataFrame:
    """The panel with its lookup key, to be stored by it (``stage_table`` with ``bucket_by=[LOOKUP_KEY]``).

    A stored panel is looked up for month after month without moving its rows; only the identity side is
    shuffled. Store one panel per way of trimming.
    """
    return keyed_for_lookup(panel, _Ids(trim, keys).lookup)


class _Ids:
    """What a panel row is looked up by, and how an answer replaces its ids."""

    def __init__(self, trim: str, keys: KeyColumns) -> None:
        at_join, at_group = _trims(trim)
        client, party = F.col(keys.client), at_join(F.col(keys.party))
        self.keys, self.known, self.named = keys, F.trim(party) != ANONYMOUS_ID, _not_unknown(client)
        self.own = at_group(client), at_group(party)
        self.lookup = F.when(self.known, _tagged(_BY_PARTY, (), party)).when(self.named, _tagged(_BY_CLIENT, (), client))

    def replaced(self, new_client: Column, new_party: Column) -> tuple[Column, Column]:
        padded = F.rpad(F.lit(ANONYMOUS_ID), PARTY_WIDTH, " ")
        client = F.when(self.known, new_client).otherwise(self.own[0])
        party = F.when(self.known, new_party).when(self.named, F.coalesce(new_party, padded)).otherwise(self.own[1])
        return client.alias(self.keys.client), party.alias(self.keys.party)


def analysis_bits(months: Sequence[int]) -> dict[int, int]:
    """One bit per analysis month, in ascending order; a set of months is a 64-bit integer."""
    if len(set(months)) > 62:
        raise ValueError("at most 62 analysis months fit into one set")
    return {m: 1 << i for i, m in enumerate(sorted(set(months)))}


def resolve_spans(
    panel: DataFrame, identity: DataFrame, bits: Mapping[int, int], window: Column, trim: str = "group",
    by: str = KEYS.analysis, duplicates: str = "raise", broadcast_rows: int | None = None, keys: KeyColumns = KEYS,
    analyses: str = "analyses",
) -> DataFrame:
    """Panel rows with the identity that each set of analysis months gives them.

    The identity table has the analysis month in column ``by``; ``bits`` numbers those months and ``window`` gives, as
    bits, the analysis months that a row belongs to. A row comes out once for each *different* answer of the
    snapshots, with the months of that answer in ``analyses``: once in all where its identity did not change, and
    not once per analysis month. With ``duplicates='multiply'`` every match is an answer of its own.
    """
    ids = _Ids(trim, keys)
    month_bits = F.create_map(*(F.lit(x) for m, b in bits.items() for x in (m, b)))
    single = lambda x: F.struct(x["new_client"].alias("c"), x["new_party"].alias("p"), month_bits[x["month"]].alias("m"))
    answers = F.transform("answers", single)
    if duplicates != "multiply":
        different = F.array_distinct(F.transform("answers", lambda x: F.struct(x["new_client"].alias("c"), x["new_party"].alias("p"))))

        def months_of(x: Column) -> Column:
            same = F.filter("answers", lambda a: a["new_client"].eqNullSafe(x["c"]) & a["new_party"].eqNullSafe(x["p"]))
            return F.aggregate(same, F.lit(0).cast("long"), lambda s, a: s.bitwiseOR(month_bits[a["month"]]))

        answers = F.transform(different, lambda x: F.struct(x["c"].alias("c"), x["p"].alias("p"), months_of(x).alias("m")))
    table = identity_lookup(identity.where(F.col(by).isin(*bits)), trim, (by,), duplicates, keys)
    table = table.select("lookup", answers.cast("array<struct<c:string,p:string,m:bigint>>").alias("answers"))
    found = lookup_join(panel.withColumn("_window", window), broadcast_if_small(table, broadcast_rows), ids.lookup, "lookup")

    given = F.coalesce("answers", F.array().cast("array<struct<c:string,p:string,m:bigint>>"))
    answered = F.aggregate(given, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x["m"]))
    nothing = F.struct(
        F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("p"),
        F.col("_window").bitwiseAND(F.bitwise_not(answered)).alias("m"),
    )
    own = F.transform(
        F.concat(given, F.array(nothing)), lambda x: F.struct(x["c"].alias("c"), x["p"].alias("p"), x["m"].bitwiseAND(F.col("_window")).alias("m"))
    )
    spans = found.withColumn("_answer", F.explode(F.filter(own, lambda x: x["m"] != 0)))
    rest = F.expr(f"* except ({keys.client}, {keys.party}, answers, _window, _answer)")
    replaced = ids.replaced(F.col("_answer.c"), F.col("_answer.p"))
    return spans.select(rest, *replaced, F.col("_answer.m").alias(analyses))


def consolidation_rule(column: str) -> str:
    name = column.upper()
    if any(t in name for t in MAX_TEXTS):
        return "max"
    if any(t in name for t in MIN_TEXTS):
        return "min"
    return "sum"


def consolidate(
    df: DataFrame, measures: Sequence[str], by: Sequence[str] = (KEYS.period, *KEYS.ids)
) -> DataFrame:
    """One row per customer and month. The rule is chosen per column; all rules combine map-side."""
    return df.groupBy(*by).agg(*(F.expr(f"{consolidation_rule(m)}(`{m}`) as `{m}`") for m in measures))

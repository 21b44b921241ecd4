"""The three channels: point of sale by merchant group, banking agent, cash machine."""

from __future__ import annotations

from collections.abc import Iterable

from featmatrix.config import CTD, FLG, MTO, TKT, Channel, Measure

# Merchant groups and operation codes that appear in the column names of the matrices.
POS_GROUPS = (
    "IG01", "IG02", "IG03", "IG04", "IG05", "IG06", "IG07", "IG08",
    "G01", "G04", "G05", "G06", "G16", "G17", "G18", "G23", "G25",
    "G28", "G31", "G34", "G35", "G39", "G43", "G45", "G46",
)
AGENT_MONETARY = (
    "", "SOL", "DOL", "RET", "DEP", "TRF", "ADS", "DIS", "PAG_TCR", "PAG_BCP", "PAG_SRV", "EMIS", "DGIR",
)
ATM_MONETARY = (
    "", "SOL", "DOL", "RET", "RET_SOL", "RET_DOL", "DEP", "DEP_SOL", "DEP_DOL",
    "TRF", "TRF_SOL", "TRF_DOL", "ADS", "DIS", "PAG_TCR", "PAG_SRV",
)
OTHER_OPERATIONS = ("", "CSLT", "ADMN")


def _named(cls: str, family: str, device: str, operation: str) -> Measure:
    return Measure("_".join(p for p in ("CAN", cls, family, device, operation) if p), cls)


def _can_measures(device: str, monetary: Iterable[str]) -> tuple[Measure, ...]:
    """Monetary operations have all classes; the others have counts and flags only."""
    monetary = tuple(monetary)
    # the total of each family leads, then the operations
    counted = [("TMO", ""), ("TNM", ""), *(("TMO", m) for m in monetary if m), *(("TNM", o) for o in OTHER_OPERATIONS if o)]
    return (
        *(_named(cls, "TMO", device, m) for cls in (MTO, TKT) for m in monetary),
        *(_named(cls, family, device, o) for cls in (CTD, FLG) for family, o in counted),
    )


def pos_channel(measures: Iterable[Measure] | None = None, name: str = "pos") -> Channel:
    """Point of sale. ``measures`` come from the concept-group metadata; the known groups by default."""
    if measures is None:
        measures = (Measure(f"POS_{cls}_TRX_{g}", cls) for cls in (MTO, TKT, CTD, FLG) for g in POS_GROUPS)
    return Channel(
        name=name,
        target="hm_matriztransaccionposmacrogiro",
        prefix="POS",
        measures=tuple(measures),
        blocks=((MTO,), (TKT,), (CTD,)),
        with_previous=frozenset((MTO, TKT, CTD)),
        trim="group",
        frequency_type="double",
        strict_flag_u1m=True,
        trim_output_party=True,
        concept_group="P2",
    )


def agent_channel() -> Channel:
    return Channel(
        name="agent",
        target="hm_matriztransaccionagente",
        prefix="CAN",
        measures=_can_measures("AGT", AGENT_MONETARY),
        blocks=((MTO, TKT), (CTD,)),
        with_previous=frozenset((MTO, TKT)),
        trim="join",
        frequency_type="bigint",
    )


def atm_channel() -> Channel:
    return Channel(
        name="atm",
        target="hm_matriztransaccioncajero",
        prefix="CAN",
        measures=_can_measures("ATM", ATM_MONETARY),
        blocks=((MTO, TKT), (CTD,)),
        with_previous=frozenset((MTO, TKT)),
        trim="join",
        frequency_type="bigint",
    )

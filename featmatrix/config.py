"""Configuration objects shared by every job."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

# Sentinels of the data model: an anonymous party is ".", and an unknown client is its SHA-512.
ANONYMOUS_ID = "."
UNKNOWN_CLIENT = hashlib.sha512(ANONYMOUS_ID.encode()).hexdigest()
PARTY_WIDTH = 12
PARTY_KEY_PREFIX = "0001"

MTO, TKT, CTD, FLG = "MTO", "TKT", "CTD", "FLG"
HORIZONS = (3, 6, 9, 12)
LOOK_BACK = 11


@dataclass(frozen=True)
class KeyColumns:
    """Names of the key columns of a monthly panel."""

    period: str = "codmes"
    analysis: str = "codmesanalisis"
    client: str = "codunicocli"
    party: str = "codinternocomputacional"
    concept: str = "codinternocomputacionalconcepto"

    @property
    def ids(self) -> tuple[str, str]:
        return self.client, self.party

    @property
    def matrix(self) -> tuple[str, str, str]:
        return self.analysis, self.client, self.party


KEYS = KeyColumns()


@dataclass(frozen=True)
class Measure:
    name: str
    cls: str


@dataclass(frozen=True)
class FeatureSpec:
    """One output column: aggregate ``fn`` of ``measure`` over the rows ``start..end`` before M."""

    name: str
    fn: str
    measure: str
    start: int
    end: int


@dataclass(frozen=True)
class Namespace:
    """Where tables are read from and where they are written to; both may be the same."""

    read: str
    write: str | None = None

    def source(self, table: str) -> str:
        return f"{self.read}.{table}"

    def target(self, table: str) -> str:
        return f"{self.write or self.read}.{table}"


@dataclass(frozen=True)
class Channel:
    """What differs between the matrices.

    ``blocks`` are runs of measure classes that are laid out together in the output.
    ``trim`` says where padded ids are trimmed: on the grouped ids, on the join id, or nowhere.
    ``with_previous`` are the classes that also get previous-block means and growth ratios.
    ``strict_flag_u1m`` rewrites the one-month flag to "exactly 1, else 0".
    """

    name: str
    target: str
    prefix: str
    measures: tuple[Measure, ...]
    blocks: tuple[tuple[str, ...], ...]
    with_previous: frozenset[str]
    trim: str
    frequency_type: str
    strict_flag_u1m: bool = False
    trim_output_party: bool = False
    concept_group: str | None = None
    keys: KeyColumns = field(default=KEYS)

    def __post_init__(self) -> None:
        if self.trim not in ("group", "join", "none"):
            raise ValueError(f"trim must be group, join or none, not {self.trim!r}")
        if not self.measures:
            raise ValueError(f"channel {self.name} has no measures")

    def names(self, *classes: str) -> list[str]:
        """Measure names, class by class, each in declaration order."""
        return [m.name for c in classes for m in self.measures if m.cls == c]

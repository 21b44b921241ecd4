"""Monthly customer feature matrices as plain Spark jobs."""

from featmatrix.config import (
    ANONYMOUS_ID,
    UNKNOWN_CLIENT,
    Channel,
    KeyColumns,
    Measure,
    Namespace,
)

__all__ = [
    "ANONYMOUS_ID",
    "UNKNOWN_CLIENT",
    "Channel",
    "KeyColumns",
    "Measure",
    "Namespace",
]

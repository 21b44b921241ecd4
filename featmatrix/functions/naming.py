"""Output column names. Names are generated once from a spec and never parsed back."""

from __future__ import annotations


def _last(n: int) -> str:
    return f"U{n}" if n == 12 else f"U{n}M"


def feature_suffix(fn: str, start: int, end: int, style: str = "all_of_n") -> str:
    """Suffix for aggregate ``fn`` over rows ``start..end`` (both <= 0; 0 is the analysis month)."""
    if style not in ("general", "all_of_n"):
        raise ValueError(f"unknown name style {style!r}")
    if not start <= end <= 0:
        raise ValueError(f"bad frame [{start}, {end}]")
    n, gap = 1 - start, -end
    previous = gap in (1, 3, 6)
    if fn == "avg":
        if start == 0:
            return "U1M"
        if previous:
            return "P1M" if gap == 1 else f"PRM_P{gap}M"
        return f"PRM_{_last(n)}"
    if fn in ("min", "max"):
        return f"{fn.upper()}_{_last(n)}"
    if fn == "sum":
        if style == "all_of_n":
            return f"X{n}_U{n}" if n == 12 else f"X{n}M_U{n}M"
        if previous:
            return "P1M" if gap == 1 else f"SUM_P{gap}M"
        return f"SUM_{_last(n)}"
    raise ValueError(f"unknown aggregate {fn!r}")


def feature_name(base: str, fn: str, start: int, end: int, style: str = "all_of_n") -> str:
    return f"{base}_{feature_suffix(fn, start, end, style)}"


def frequency_suffix(n: int) -> str:
    return f"FRQ_{_last(n)}"

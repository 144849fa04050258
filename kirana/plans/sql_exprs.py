"""DuckDB SQL expression templates for the oracle (independent of the
Spark Column builders)."""

from __future__ import annotations


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_phone(x: str) -> str:
    d = f"regexp_replace(coalesce({x}, ''), '[^\\p{{Nd}}]', '', 'g')"
    return (f"(CASE WHEN length({d}) = 12 AND starts_with({d}, '91') THEN substr({d}, 3) "
            f"WHEN length({d}) = 11 AND starts_with({d}, '0') THEN substr({d}, 2) ELSE {d} END)")


def canon_phone(x: str) -> str:
    raw = strip(x)
    n = norm_phone(raw)
    return f"(CASE WHEN length({n}) = 10 THEN '+91' || {n} ELSE {raw} END)"


def money(x: str) -> str:
    """Exact money sum -> double."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"

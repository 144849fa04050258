"""All registered queries (imports the q_* modules for their side effect)."""

from __future__ import annotations

import importlib

from kirana.plans.base import REGISTRY, Query

_MODULES = ("q_store", "q_orders", "q_ledger", "q_calls", "q_search", "q_text", "q_sinks", "q_replay", "q_tools", "q_stream")

for _m in _MODULES:
    importlib.import_module(f"kirana.plans.{_m}")


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)

"""All registered queries of the core."""

from __future__ import annotations

import importlib

from palimpsest.plans.registry import ORACLES, QUERIES, Query

MODULES = ("sequences", "stories", "aggregates", "audits", "texts", "answers", "records", "streams", "contracts", "files")

for _m in MODULES:
    importlib.import_module(f"palimpsest.plans.{_m}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

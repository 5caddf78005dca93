"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("gate_checks", "source_checks", "feature_checks", "scenario_checks", "governance_checks", "model_checks", "stream_checks", "plan_checks", "store_checks")


def _load(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(f"wattloom.workbench.{m}"), attr)
        twice = out.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out.update(part)
    return out


def queries() -> dict:
    return _load("QUERIES")


def oracles() -> dict:
    return _load("ORACLES")

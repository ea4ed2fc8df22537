"""Registered queries by family."""

from __future__ import annotations

import importlib

FAMILIES = ("scalars", "relational", "rain", "spatial", "scoring", "streams")


def load():
    from hydrolens.workload.registry import REGISTRY

    for family in FAMILIES:
        importlib.import_module(f"hydrolens.workload.{family}")
    return dict(REGISTRY)

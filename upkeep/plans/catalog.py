"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = [
    "upkeep.plans.q_labels",
    "upkeep.plans.q_prep",
    "upkeep.plans.q_features",
    "upkeep.plans.q_model",
    "upkeep.plans.q_serving",
    "upkeep.plans.q_lifecycle",
    "upkeep.plans.q_sources",
    "upkeep.plans.q_train",
    "upkeep.plans.q_streaming",
]


def load() -> None:
    for m in MODULES:
        importlib.import_module(m)

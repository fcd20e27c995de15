"""All registered queries, by area."""
from __future__ import annotations

import importlib

AREAS = ("learner", "adaptive", "text", "retrieval", "exams", "knowledge", "quality", "evidence")


def load_all() -> tuple[dict, dict]:
    for area in AREAS:
        importlib.import_module(f"evalspark.catalog.{area}")
    from evalspark.catalog.base import ORACLES, QUERIES
    return QUERIES, ORACLES

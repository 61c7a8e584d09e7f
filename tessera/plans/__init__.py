"""Named queries, one module a subject."""

from __future__ import annotations

import importlib

MODULES = ("graphs", "search", "facts", "temporal", "texts", "tables", "evaluation", "replication", "events", "reviews", "surface", "lists", "intake", "gap_report", "seeded", "neighbours", "digests", "queues", "feeds")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")

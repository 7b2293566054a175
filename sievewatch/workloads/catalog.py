"""All registered queries."""

from __future__ import annotations

from . import alerts, detections, knowledge, retrieval, streams, texts

MODULES = [alerts, knowledge, retrieval, texts, detections, streams]


def jobs() -> dict:
    return {name: job for m in MODULES for name, job in m.R.jobs.items()}


def oracle() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}

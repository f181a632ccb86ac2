"""All named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from quaero.plans import evaluation, files, retrieval, streams, texts, training


MODULES = [retrieval, evaluation, texts, training, files, streams]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

"""Named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import corpus, program


def queries() -> dict:
    return program.QUERIES | corpus.QUERIES


def oracle_sql() -> dict[str, str]:
    return program.ORACLES | corpus.ORACLES

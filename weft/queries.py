"""Every query of the library, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.catalogue import capabilities, evidence, extraction, portfolio, projects, texts, upkeep
from weft.catalogue.standins import even_rounded

_SUBJECTS = (capabilities, evidence, portfolio, extraction, projects, texts, upkeep)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for s in _SUBJECTS for k, f in s.QUERIES.items()}
ORACLES: dict[str, str] = {k: even_rounded(q) for s in _SUBJECTS for k, q in s.ORACLES.items()}

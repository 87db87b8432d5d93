"""All queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import metrics
from . import chat, corpus, experiments, grammars, mixture, scoring, selection, sequences, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (corpus, chat, mixture, selection, scoring, experiments, sequences, grammars, training, metrics):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL

"""Queries of the seismic engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL for the oracle engine."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


from . import analysis, analytics, catalog, evidence, features, hazards, intake, labels, live, matrix, places, profiles, sequences, series, sky, streams, threat, waves  # noqa: E402, F401  (they register their queries)

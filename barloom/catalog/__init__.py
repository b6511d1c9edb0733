"""Registered queries and their SQL cross-checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.catalog.base import ORACLES, QUERIES

MODULES = ("sources", "features", "folds", "metrics", "calibration", "econometrics", "regime", "blend", "text", "streams")


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"barloom.catalog.{m}")
    return dict(QUERIES), dict(ORACLES)

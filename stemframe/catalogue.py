"""Imports every query module, so that the registry is full, and hands out its contents."""

from __future__ import annotations

import importlib

from stemframe.registry import ORACLES, QUERIES, Query

MODULES = [
    "stemframe.plans.flagship",
    "stemframe.sources.media",
    "stemframe.plans.catalog",
    "stemframe.plans.naming",
    "stemframe.operators.level",
    "stemframe.operators.frames",
    "stemframe.operators.spectral",
    "stemframe.operators.pair",
    "stemframe.operators.bands",
    "stemframe.streaming.jobs",
    "stemframe.functions.udf",
    "stemframe.sources.wav",
    "stemframe.sources.preprocess",
    "stemframe.operators.pitch",
    "stemframe.operators.dataset",
    "stemframe.operators.ensemble",
    "stemframe.operators.metrics",
]


def queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(name)
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)

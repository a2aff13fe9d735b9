"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rxgrid.plans.context import Context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CONTEXTS: dict[tuple[int, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (id(spark), sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


def q(name: str):
    """Register ``fn(ctx) -> DataFrame`` as query ``name``."""

    def deco(fn: Callable[[Context], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(context(spark, sf_dir))
        return fn

    return deco

"""Registry of runnable queries with the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``covers`` lists inventory ids separated by blanks."""

    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    """Import every plan module and return the registry."""
    from . import (  # noqa: F401
        aggregate_plans,
        design_plans,
        flagship,
        join_plans,
        model_plans,
        curve_plans,
        inference_plans,
        nested_plans,
        projection_plans,
        resampling_plans,
        roi_plans,
        signal_plans,
        source_plans,
        stream_plans,
        text_plans,
        window_plans,
    )

    return REGISTRY

"""Pipelines of steps over a context, which is a dict with the table under 'data' and the mode under 'mode'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[dict], dict]


def lift(fn: Callable[..., DataFrame], *args, **kwargs) -> Step:
    """A function of a table and more arguments as a step."""
    return lambda ctx: ctx | {"data": fn(ctx["data"], *args, **kwargs)}


def fitted(name: str, fit: Callable[..., object], transform: Callable[[DataFrame, object], DataFrame], *args, **kwargs) -> Step:
    """A step that fits in mode 'fit' and keeps what it has found under its name, and in mode 'transform' applies it."""

    def step(ctx: dict) -> dict:
        model = fit(ctx["data"], *args, **kwargs) if ctx["mode"] == "fit" else ctx[name]
        return ctx | {name: model, "data": transform(ctx["data"], model)}

    return step


def pipeline(*steps: Step) -> Step:
    def run(ctx: dict) -> dict:
        for s in steps:
            ctx = s(ctx)
        return ctx

    return run


def fit(df: DataFrame, *steps: Step) -> dict:
    return pipeline(*steps)({"mode": "fit", "data": df})


def transform(df: DataFrame, ctx: dict, *steps: Step) -> dict:
    return pipeline(*steps)(ctx | {"mode": "transform", "data": df})

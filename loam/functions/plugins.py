"""Where models plug in: scorers, summarisers and embedders as plain functions of columns or batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

Scorer = Callable[[Column, Column], Column]
Transform = Callable[[DataFrame], DataFrame]

_registry: dict[str, Callable] = {}


def register(name: str, fn: Callable) -> Callable:
    """Keep a function under a name, for pipelines that are configured by name."""
    _registry[name] = fn
    return fn


def lookup(name: str) -> Callable:
    if name not in _registry:
        raise KeyError(f"no plug-in named {name}; there are {sorted(_registry)}")
    return _registry[name]


def register_sql(spark: SparkSession, name: str, fn: Callable, returns: str) -> None:
    """Make a vectorised function callable from SQL."""
    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(fn, returns))


def embedded(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64) -> DataFrame:
    """df with an embedding column; encode sees batches of texts and may hold a client for the partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield frame.assign(embedding=vectors)

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, embedding array<float>")


#: JSON Schema types of Python types.
JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def tool(fn: Callable) -> Callable:
    """Register a function under its name, with a JSON Schema of its parameters from its type hints."""
    import inspect
    import typing

    hints = typing.get_type_hints(fn)
    fields = {n: {"type": JSON_TYPES.get(typing.get_origin(hints.get(n)) or hints.get(n), "string")} for n in inspect.signature(fn).parameters}
    needed = [n for n, p in inspect.signature(fn).parameters.items() if p.default is p.empty]
    fn.schema = {"name": fn.__name__, "description": inspect.getdoc(fn) or "", "parameters": {"type": "object", "properties": fields, "required": needed}}
    return register(fn.__name__, fn)


def tools() -> list[dict]:
    return [fn.schema for fn in _registry.values() if hasattr(fn, "schema")]


def chained(search: Transform, rerank: Transform | None = None) -> Transform:
    """A search and, if given, a reranker as one transform."""
    return lambda queries: queries.transform(search) if rerank is None else queries.transform(search).transform(rerank)

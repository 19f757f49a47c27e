"""The key functions for SQL: ``value_keys`` and ``pattern_keys`` as table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from glyphlake.functions.keys import keys_of, shown
from glyphlake.functions.params import IndexParams
from glyphlake.plans.pattern import pattern_keys


@udtf(returnType="key string")
class ValueKeys:
    def eval(self, value: str, k: int = 3, cap: int = 2, rollup: int = 3, reverse_depth: int = 1, composite: bool = True, cross_edges: bool = False, anchor_len: int = 4, skip_depth: int = 4) -> Iterator[tuple[str]]:
        if value is not None:
            params = IndexParams(k=k, cap=cap, rollup=rollup, reverse_depth=reverse_depth, composite=composite, cross_edges=cross_edges, anchor_len=anchor_len, skip_depth=skip_depth)
            for key in sorted(map(shown, keys_of(value, params))):
                yield (key,)


@udtf(returnType="key string")
class PatternKeys:
    def eval(self, pattern: str, k: int = 3, cap: int = 2, rollup: int = 3, reverse_depth: int = 1, composite: bool = True, cross_edges: bool = False, anchor_len: int = 4, skip_depth: int = 4, ilike: bool = False) -> Iterator[tuple[str]]:
        if pattern is not None:
            params = IndexParams(k=k, cap=cap, rollup=rollup, reverse_depth=reverse_depth, composite=composite, cross_edges=cross_edges, anchor_len=anchor_len, skip_depth=skip_depth)
            for key in sorted(map(shown, pattern_keys(pattern, params, ilike))):
                yield (key,)


def register(spark: SparkSession) -> None:
    spark.udtf.register("value_keys", ValueKeys)
    spark.udtf.register("pattern_keys", PatternKeys)


def pattern_keys_frame(spark: SparkSession, patterns: list[tuple[str, bool]], params: IndexParams | None = None) -> DataFrame:
    """(pattern, ilike, key) of several patterns."""
    rows = [(p, i, shown(k)) for p, i in patterns for k in sorted(pattern_keys(p, params or IndexParams(), i))]
    return spark.createDataFrame(rows, "pattern string, is_ilike boolean, key string")

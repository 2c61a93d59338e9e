"""Indexes that are built once and searched often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchline.operators.fulltext import Index
from parchline.session import Scratch, forget

_BUILT: dict[tuple[str, str], tuple[str, str]] = {}


def stored(spark: SparkSession, name: str, corpus: Callable[[], DataFrame], key: str, text: str, fresh: bool = False) -> Index:
    """The index called ``name`` of this application. It is built from ``corpus`` when it is first asked for, or ``fresh``, and opened after
    that: a name stands for one state of a corpus. It lies in the shared folder until the application ends."""
    at = (spark.sparkContext.applicationId, name)
    if fresh or at not in _BUILT:
        path = f"{Scratch(spark, 'index').base}/index"
        index = Index.build(corpus(), key, text, path)
        _BUILT[at] = (path, key)
        forget(lambda: _BUILT.pop(at, None))
        return index
    return Index.open(spark, _BUILT[at][1], _BUILT[at][0])

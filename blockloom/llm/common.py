"""What workers keep between tasks, and small column helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python workers keep between tasks, by operator, and how to forget it.
_KEPT: dict[str, Callable[[], None]] = {}
_USER: list[str] = [""]


def claim(user: str, forget: Callable[[], None] | None = None) -> None:
    """Called in a worker by an operator at work: what other operators left in the worker's memory goes.

    Workers outlive tasks, so caches of one stage would else stand beside those of the next.
    """
    if forget:
        _KEPT[user] = forget
    if _USER[0] != user:
        _USER[0] = user
        for other, clear in _KEPT.items():
            if other != user:
                clear()


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, lengthened until none equals a taken one in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def by_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id long`` and ``text string``, a null text read as empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def hash_pair(x: Column) -> Column:
    """A 128-bit key of a value as a struct of two 64-bit hashes of different seeds."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))


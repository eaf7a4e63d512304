"""Columns of the caller beside those that an operator makes for itself.

Inside this library, names of intermediate columns begin with "_". A caller's columns that do are renamed for the time
of the operation and get their names back, so nothing of theirs is lost or replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that keep extra columns of their first argument; other arguments may name those columns."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        odd = [c for c in df.columns if c.startswith("_")]
        if not odd:
            return operator(df, *args, **kwargs)
        taken = {c.lower() for c in df.columns}
        other = {}
        for c in odd:
            name = f"kept{c}"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            other[c] = name

        def named(x):
            if isinstance(x, str):
                return other.get(x, x)
            return type(x)(map(named, x)) if isinstance(x, (list, tuple)) else x

        out = operator(df.withColumnsRenamed(other), *map(named, args), **{k: named(v) for k, v in kwargs.items()})
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def key_of(keys: Sequence[str]) -> Column:
    """One text for the values of all keys, which tells apart what they tell apart and isn't null where they are.

    Joins on it keep rows with null keys; each value is led by its length, so that none runs into the next.
    """
    texts = [F.col(k).cast("string") for k in keys]
    return F.concat_ws(",", F.lit(""), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in texts])

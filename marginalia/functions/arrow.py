"""Functions over Arrow batches as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable:
    """A pandas function as a Column function. It is made when called, as types can't be parsed where modules load without a session."""

    def wrap(f: Callable) -> Callable:
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap

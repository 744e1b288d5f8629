"""Arrow-batched functions that are set up when first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def arrow_function(return_type: str, once: bool = False) -> Callable:
    """As ``pandas_udf(return_type)``, but set up at each use.

    ``once`` keeps the optimizer from copying the call into filters that it moves down, which would
    run a costly function twice.
    """

    def decorate(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*columns) -> Column:
            ship(SparkSession.active())
            udf = F.pandas_udf(fn, return_type)
            return (udf.asNondeterministic() if once else udf)(*columns)

        return call

    return decorate

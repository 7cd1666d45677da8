"""IPv6 text needs a parser: Arrow-batched functions over the standard one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from umbra.operators.corpus import importable
from umbra.plans import rulebook as book
from umbra.plans.rendering import address_class, parse_address


def ipv6_class(column: str, resolvers: tuple[str, ...] = book.V6_RESOLVERS) -> Column:
    """The class of an IPv6 address, null for any other text."""
    known = frozenset(resolvers)
    importable(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: address_class(t, known) if isinstance(t, str) and parse_address(t, 6) is not None else None)

    return run(column)

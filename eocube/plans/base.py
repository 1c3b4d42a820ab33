"""Registration of queries."""

from __future__ import annotations

import re

from ..sources.adapters import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, text: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, its SQL over the adapters' tables."""

    def add(f):
        QUERIES[name] = f
        if text:
            # SQL's date parts are long there and int in Spark.
            ORACLE[name] = sql(re.sub(r"\b(year|month|dayofyear|day)\(([\w.\"]+)\)", r"CAST(\1(\2) AS INT)", text.strip()))
        return f

    return add

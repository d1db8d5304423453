"""Versions of the extraction methods: a digest of the source that defines them, so a changed engine shows in its results."""

from __future__ import annotations

import hashlib
import inspect
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import patterns as P


@cache
def artifact(method: str) -> str:
    """METHOD-sha256: and 16 hex digits of the source of the patterns and operators that the method is made of."""
    from spanforge.functions import spans
    from spanforge.operators import extract, model, support, validate

    used = [P, spans, extract, support, validate, *([model] if method == "ml" else [])]
    source = "\n".join(inspect.getsource(m) for m in used)
    return f"{method}-sha256:{hashlib.sha256(source.encode()).hexdigest()[:16]}"


def version(method: Column) -> Column:
    """The version of a method by name; null for others."""
    out = F.lit(None).cast("string")
    for m in P.METHODS:
        out = F.when(method == m, F.lit(artifact(m))).otherwise(out)
    return out

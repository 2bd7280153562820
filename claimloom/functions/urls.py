"""Joining URLs: the common forms natively, dotted paths with the standard library."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*:"


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1), F.lit(""))


def join_simple(base: Column, ref: Column) -> Column:
    """``ref`` against ``base`` where no path has dotted segments; null where it has."""
    origin = F.regexp_extract(base, "^([^/?#]+//[^/?#]*)", 1)
    page = F.regexp_replace(base, "#.*$", "")
    path = F.regexp_replace(page, r"\?.*$", "")
    folder = F.when(F.regexp_like(path, F.lit("^[^/]+//[^/]*$")), F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(base.isNull() | ref.isNull(), F.lit(None).cast("string"))
        .when(ref == "", base)
        .when(F.regexp_like(ref, F.lit(r"(^|/)\.\.?(/|$|\?|#)")), F.lit(None).cast("string"))
        .when(F.regexp_like(ref, F.lit(_ABSOLUTE)), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([^/]+)//", 1), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("#"), F.concat(page, ref))
        .when(ref.startswith("?"), F.concat(path, ref))
        .otherwise(F.concat(folder, ref))
    )


def join_any(base: Column | str, ref: Column | str) -> Column:
    """Any reference, dotted segments included, by the standard library."""

    @pandas_udf("string")
    def run(bases: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(bases, refs, strict=True)])

    return run(base, ref)


def level_url(url: Column, level: Column) -> Column:
    """``.htm`` becomes ``-level.htm``, wherever it stands."""
    return F.replace(url, F.lit(".htm"), F.concat(F.lit("-"), F.lower(level), F.lit(".htm")))

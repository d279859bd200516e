"""Hashes, JSON payloads and ages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import col


def param_hash(**params) -> Column:
    """md5 of the parameters as JSON with sorted keys."""
    fields = [col(params[name]).alias(name) for name in sorted(params)]
    return F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def age_seconds(now, created_at) -> Column:
    return F.unix_timestamp(col(now).cast("timestamp")) - F.unix_timestamp(col(created_at).cast("timestamp"))


def iso_text(ts) -> Column:
    """ISO text; the fraction is written only if there is one."""
    plain = F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.endswith(exact, F.lit(".000000")), plain).otherwise(exact)


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))

"""Rows of two engines in one form, for comparison without order."""

import datetime
import math


def norm(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "to_integral_value"):
        return float(v)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)


def rows_of_sql(con, sql):
    result = con.sql(sql)
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    return columns, sorted((tuple(norm(r[i]) for i in at) for r in result.fetchall()), key=str)

"""Rows of two frames as text, whatever the column order."""

import datetime
import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "~"
    if isinstance(v, (datetime.datetime, datetime.date)) or hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return repr(float(v) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in pdf[columns].itertuples(index=False, name=None))

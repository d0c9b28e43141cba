"""Rows of a query and of its oracle in one comparable form."""

import math


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str(tuple(_norm(r[c]) for c in cols)) for r in df.collect())


def duck_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(str(tuple(_norm(r[k]) for k in at)) for r in got.fetchall())

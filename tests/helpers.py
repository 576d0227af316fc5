import math
from collections import Counter


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 6)
    return v


def same_rows(df, cur):
    cols = df.columns
    got = Counter(tuple(norm(x) for x in r) for r in df.collect())
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols), (cols, ocols)
    idx = [ocols.index(c) for c in cols]
    exp = Counter(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == exp, (list((got - exp).elements())[:3], list((exp - got).elements())[:3])
    return sum(got.values())

"""Bounded samples by hash."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.store import stored


def quotas(distinct: dict, rows: int) -> dict:
    """``rows`` dealt evenly over the labels; what a label with few keys leaves goes to the others."""
    out, left = {}, rows
    for i, (k, d) in enumerate(sorted(distinct.items(), key=lambda x: x[1])):
        out[k] = min(d, -(-left // (len(distinct) - i)))
        left -= out[k]
    return out


def lowest(df: DataFrame, key: str, rows: int, n: int, label: str | None = None) -> DataFrame:
    """min(``rows``, different keys) rows of different ``key`` (a 64-bit hash), those of lowest key; of rows with one
    key the smallest. With ``label`` the labels (few, not null) get equal shares, those of lowest key each, and a label
    of fewer keys all of its own. ``n``: rows of ``df`` or more.

    A large table is first cut by a bound on the key that about four times the rows wanted of each label meet, counted
    in different keys, so that copies do not shrink the sample; a bound that lets too few pass is widened. So no task
    and no merge sees more of a large table."""
    lab = F.lit(0) if label is None else F.col(label)
    rest = [c for c in df.columns if c != key]
    each = lambda d: d.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")
    if n <= 4 * rows:
        found = each(df) if label is None else stored(each(df))
    else:
        counted = df.groupBy(lab.alias("label")).agg(F.approx_count_distinct(key).alias("d")).where("label is not null").collect()
        want = quotas({r["label"]: r["d"] for r in counted}, rows)
        share = {r["label"]: min(1.0, 4 * want[r["label"]] / max(r["d"], 1)) for r in counted}
        while True:
            passes = F.lit(False)
            for k, s in share.items():
                passes |= (lab == F.lit(k)) & (F.lit(s == 1.0) | (F.col(key) < min(int(-(1 << 63) + s * (1 << 64)), (1 << 63) - 1)))
            found = stored(each(df.where(passes)))
            got = {r["label"]: r["count"] for r in found.groupBy(lab.alias("label")).count().collect()}
            short = [k for k, s in share.items() if s < 1.0 and got.get(k, 0) < want[k]]
            if not short:
                break
            share |= {k: min(1.0, 4 * share[k]) for k in short}
    if label is None:
        return found.orderBy(key).limit(rows)
    got = {r[label]: r["count"] for r in found.groupBy(label).count().where(F.col(label).isNotNull()).collect()}
    parts = [found.where(lab == F.lit(k)).orderBy(key).limit(q) for k, q in quotas(got, rows).items()]
    return reduce(DataFrame.unionByName, parts) if parts else found.limit(0)

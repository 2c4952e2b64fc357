"""Ordered walks whose state crosses parts of a series, replayed in parallel.

A walk that decides row by row what later rows may do cannot be cut into independent pieces, but its state is short
lived: what a day hands to the next one is small and mostly does not depend on what that day itself was handed. So
every part (a day, say) is replayed at once from a guessed entry state. Each then tells its exit state, the exit states
become the entry states of the next parts, and only parts whose entry state changed are replayed, until none does.
After round k the first k parts of every key are final, so the result is that of the plain walk; a state that forgets
settles in a few rounds, whatever the length of the series.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .store import stored

# What a part hands over: a long per name, by name.
STATE = "array<struct<name: string, value: long>>"
Walk = Callable[[pd.DataFrame, dict[str, int]], tuple[pd.DataFrame, dict[str, int]]]


def _as_dict(state) -> dict[str, int]:
    return {s["name"]: int(s["value"]) for s in state}


def replayed(rows: DataFrame, keys: Sequence[str], part: str, walk: Walk, schema: T.StructType,
             live: Callable[[Column, Column], Column], rounds: int | None = None) -> tuple[DataFrame, int]:
    """(what the walk returns over all rows, rounds needed).

    ``rows`` fall into parts by the number in column ``part``, each small enough for one task. ``walk(rows of a part,
    entry state)`` gives result rows of ``schema`` and the exit state; ``live(state entry, part)`` says which
    entries still matter to a part, so that two entry states that cannot make a difference are equal. ``rounds``
    makes it an error to need more. Null keys are keys of their own; no rows give no result.
    """
    keys, at = list(keys), [*keys, part]
    rows = stored(rows)
    empty = F.array().cast(STATE)
    states = rows.select(*at).distinct().withColumns({"_entry": empty, "_exit": empty})
    out = T.StructType([*[rows.schema[k] for k in at], *T._parse_datatype_string(f"_entry {STATE}, _exit {STATE}").fields])

    def leave(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        entry = _as_dict(s["_entry"].iloc[0])
        left = walk(p, dict(entry))[1]
        as_rows = lambda d: [{"name": k, "value": v} for k, v in sorted(d.items())]
        return s[at].assign(_entry=[as_rows(entry)], _exit=[as_rows(left)])

    def trade(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return walk(p, _as_dict(s["_entry"].iloc[0]))[0][schema.fieldNames()]

    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in at]
    pick = lambda d, c: d.alias("r").join(c.alias("c"), [*same], "left_semi")
    states = stored(rows.groupBy(*at).cogroup(states.groupBy(*at)).applyInPandas(leave, out))
    order, n = Window.partitionBy(*keys).orderBy(part), 1
    while True:
        before = F.coalesce(F.lag("_exit").over(order), empty)
        states = states.withColumn("_new", before)
        states = stored(states.withColumn("_new", F.filter("_new", lambda s: live(s, F.col(part)))))
        stale = F.col("_new") != F.col("_entry")
        again = states.where(stale).select(*at, F.col("_new").alias("_entry"), "_exit")
        if again.isEmpty():
            break
        n += 1
        if rounds is not None and n > rounds:
            raise RuntimeError(f"entry states still change after {rounds} rounds")
        done = pick(rows, again).groupBy(*at).cogroup(again.groupBy(*at)).applyInPandas(leave, out)
        states = stored(states.where(~stale).drop("_new").unionByName(done))
    return rows.groupBy(*at).cogroup(states.groupBy(*at)).applyInPandas(trade, schema), n

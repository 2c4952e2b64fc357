"""Line dedup by the spread of a line over sites.

A HyperLogLog sketch of the sites is built for every line hash; Spark merges the sketches as partial aggregates.
Lines whose estimate is clear of the threshold are decided by it, those near it by an exact distinct count.
"""
from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.store import stored


BLANKS = " \t\r"
SALTS = 16


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    return F.xxhash64(bare(line))


def _row_key(id_col: str, text_col: str) -> Column:
    """Rows that share it have their line sets merged, which changes nothing: a set only lists lines to go."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str, long_chars: int) -> DataFrame:
    """Every line that is not blank: row, site, hash, whether it is long, and a salt that even repeated rows differ in."""
    each = docs.select(_row_key(id_col, text_col).alias("rid"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                       F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
                       F.explode(F.split(F.col(text_col), "\n", -1)).alias("line"))
    n = F.length(bare(F.col("line")))
    return each.where(n > 0).select("rid", "site", "salt", line_key(F.col("line")).alias("h"), (n >= long_chars).alias("long"))


def _rows_of(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose hash is in ``keys``. The keys, one row per line text, are repeated per salt, so that
    the rows of a hot line meet in as many partitions."""
    each = keys.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return lines.join(each, ["h", "salt"], "left_semi")


def spread_lines(lines: DataFrame, min_sites: int, long_sites: int | None = None, lg_k: int = 12, sigmas: float = 4.0) -> DataFrame:
    """Hashes of the lines found on at least ``min_sites`` sites, long ones on ``long_sites``."""
    sketch = F.hll_sketch_agg("site", F.lit(lg_k))
    est = stored(lines.groupBy("h").agg(F.hll_sketch_estimate(sketch).alias("est"), F.bool_or("long").alias("long")))
    need = F.when(F.col("long"), long_sites or min_sites).otherwise(min_sites)
    band = sigmas * 1.04 / sqrt(1 << lg_k)
    lo, hi = need * (1 - band) - 1, need * (1 + band) + 1
    near = est.where((F.col("est") >= lo) & (F.col("est") <= hi)).select("h")
    exact = (_rows_of(lines, near).groupBy("h").agg(F.countDistinct("site").alias("n"), F.bool_or("long").alias("long"))
             .where(F.col("n") >= need).select("h"))
    return est.where(F.col("est") > hi).select("h").unionByName(exact)


def sites_needed(lines: DataFrame, most: int) -> int:
    """Half of the sites of the table, at most ``most``, at least two."""
    return max(2, min(most, (lines.select("site").distinct().count() + 1) // 2))


def strip_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = 10, long_sites: int = 3, long_chars: int = 250, min_left: float = 0.1) -> DataFrame:
    """Columns ``row`` (all of docs), ``text`` (without the lines), ``n_lines``, ``n_cut`` and ``spared``.

    Lines are compared without outer blanks; blank ones stay. A line goes if it is on ``min_sites`` sites, or on half of
    the sites if a table has fewer than twice as many; a line of ``long_chars`` characters, which no two authors write
    by chance, needs ``long_sites`` at most. A document that would keep less than ``min_left`` of its characters is a
    copy as a whole, not a page with boilerplate; it is spared and left to near-duplicate removal. Null and missing
    sites are one site; null texts have no lines and stay null, empty ones stay empty; repeated rows count their site
    once and are treated alike; other columns pass through, whatever their names. A very long text costs its lines once
    and the set of those that go once more. Hot lines are pre-aggregated before every shuffle; the texts are shuffled
    once, joined by row to the set of their lines that go (many equal rows: split by AQE as a skewed join).
    """
    lines = stored(lines_of(docs, id_col, text_col, site_col, long_chars))
    need = sites_needed(lines, min_sites)
    wide = stored(spread_lines(lines, need, min(need, long_sites)))
    cut = _rows_of(lines, wide).groupBy("rid").agg(F.collect_set("h").alias("gone"))
    d = docs.select(F.struct("*").alias("row"), _row_key(id_col, text_col).alias("rid")).join(cut, "rid", "left")
    text, gone = F.col("row")[text_col], F.col("gone")
    every = F.split(text, "\n", -1)
    left = F.when(gone.isNotNull(), F.filter(every, lambda line: ~F.array_contains(gone, line_key(line))))
    d = d.select("row", F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_lines"), left.alias("left"))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    total = chars(F.split(F.col("row")[text_col], "\n", -1))
    d = d.select("row", "n_lines", "left", F.when(F.col("left").isNotNull(), chars(F.col("left")) < min_left * total).otherwise(F.lit(False)).alias("spared"))
    done = F.col("left").isNotNull() & ~F.col("spared")
    return d.select("row", F.when(done, F.array_join("left", "\n")).otherwise(F.col("row")[text_col]).alias("text"), "n_lines",
                    F.when(done, F.col("n_lines") - F.size("left")).otherwise(F.lit(0)).cast("long").alias("n_cut"), "spared")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **kw) -> DataFrame:
    """``docs`` with the lines gone from the text column, other columns unchanged but for the length, which is counted
    anew where a line went. Null and empty texts, null ids and repeated rows stay as they are in ``strip_lines``."""
    d = strip_lines(docs, id_col, text_col, **kw)
    new = {text_col: F.col("text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("n_cut") > 0, F.length("text").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row")[chars_col])
    return d.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])

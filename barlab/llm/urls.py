"""URL filters: host and path rules first, logistic regression on hashed character n-grams for the rest.

Only DataFrame functions and Spark ML transformers that run in the JVM.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.store import stored
from .pii import let
from .sampling import lowest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: list[Rule], what) -> Column:
    """``what`` of the longest rule that fits the host or a parent domain and the start of the path, else null.
    The rules are a short list held in the plan; of equally long ones a blocking rule goes first."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, what(r)) if out is None else out.when(fits, what(r))
    return F.lit(None).cast("string") if out is None else out


def grams(host: Column, path: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of both parts, marked with the part and with its ends."""
    def of(tag: str, text: Column) -> Column:
        def cut(c: Column) -> Column:
            start = lambda n: F.sequence(F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(1)))
            long = lambda n: F.transform(start(n), lambda i: F.concat(F.lit(tag), F.array_join(F.slice(c, i, F.lit(n)), "")))
            return F.flatten(F.array(*map(long, sizes)))
        # from an array of characters: cutting the string itself would count from its start for every n-gram
        return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), cut)

    return F.concat(of("h", host), of("p", path))


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4), features: int = 1 << 15, rows: int = 20000,
          iterations: int = 30, reg: float = 1e-3) -> PipelineModel | None:
    """Fit on host, path and label (1: block) of at most ``rows`` different urls, those of lowest hash of host and path of
    each class. None if one class is missing."""
    sample = labelled.select(F.xxhash64("host", "path").alias("at"), "host", "path", F.col("label").cast("double").alias("label"))
    sample = lowest(sample, "at", rows, labelled.count(), "label")
    sample = stored(sample.withColumn("grams", grams(F.col("host"), F.col("path"), sizes)))
    if sample.select("label").distinct().count() < 2:
        return None
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    model = LogisticRegression(maxIter=iterations, regParam=reg, standardization=False).fit(hashed.transform(sample))
    return PipelineModel([hashed, model])


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", default: str = "allow", sizes: tuple[int, ...] = (3, 4), **fit) -> DataFrame:
    """One row per page: host, path, rule, verdict ('allow' or 'block').

    ``labelled`` has url and label (1: block), a small table such as ``sample_urls.labelled``. Without it the pages that
    a rule decides are the labels, which teaches little if the rules of one verdict share a domain. If one class is
    missing, pages without a rule get ``default``. Cost and memory grow with the length of a url, however long. Null urls
    and urls without a host are judged on empty parts; repeated rows and null ids stay; other columns are not read. No
    shuffle besides the training sample, which is bounded by the ``rows`` of ``train``.
    """
    host, path = parts(F.col(url_col))
    d = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    d = d.withColumn("rule", by_rule(h, p, rules, lambda r: F.lit(r.name)))
    said = by_rule(h, p, rules, lambda r: F.lit(r.verdict))
    if labelled is None:
        known = d.where(F.col("rule").isNotNull()).withColumn("label", (said == "block").cast("int"))
    else:
        lh, lp = parts(F.col("url"))
        known = labelled.select(lh.alias("host"), lp.alias("path"), "label")
    model = train(known, sizes, **fit)
    if model is None:
        d = d.withColumn("guess", F.lit(default))
    else:
        # pages that a rule decides need no score
        d = d.withColumn("grams", F.when(F.col("rule").isNull(), grams(h, p, sizes)).otherwise(F.array().cast("array<string>")))
        d = model.transform(d).withColumn("guess", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    return d.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(said, F.col("guess")).alias("verdict"))

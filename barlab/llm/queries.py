"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.store import stored
from ..session import use_utc
from . import decontam, extraction, langid, lexical, lines, packing, periodic, pii, repetition, sample_urls, secret_scan, simhash, tokens, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed values of the contract.
URL_RULES = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
             urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]
URL_FIT = {"iterations": 100, "reg": 1e-5}   # chosen on held-out rows of the labelled table
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def joined_digest(a):
    return F.sha2(F.array_join(a, ","), 256)


_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD1 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query("op1_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_AZ}, {_WORD1}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_AZ}, {_WORD1}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM
       (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT r, k, i, item_id FROM dw JOIN bw USING (k, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""")
def _(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_token_counts")
def _(spark, sf_dir):
    from public_tokenizers import path
    return tokens.token_counts(table(spark, sf_dir, "documents"), path(VOCABULARY))


_LIMITS = repetition.Limits()
_COVER = " AND ".join(f"coalesce(in_{k}, 0) <= CAST({v} AS DOUBLE) * word_chars" for k, v in _LIMITS.coverage.items())
_SIZES = ", ".join(map(str, [_LIMITS.window, *_LIMITS.coverage]))


@query("op3_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
a AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
l AS (SELECT r, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c, row_number() OVER (PARTITION BY r, line) AS n
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
dl AS (SELECT r, count(*) AS n_dup_lines, CAST(sum(c) AS BIGINT) AS dup_line_chars FROM l WHERE c > 0 AND n > 1 GROUP BY r),
g AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM
      (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([{_SIZES}]) AS k) WHERE len(w) >= k)),
dup AS (SELECT r, k, i FROM (SELECT r, k, i, count(*) OVER (PARTITION BY r, k, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT DISTINCT r, k, p FROM (SELECT r, k, unnest(generate_series(i, i + k - 1)) AS p FROM dup)),
c AS (SELECT r, count(*) FILTER (k = {_LIMITS.window}) AS n_repeat_words, {", ".join(f"CAST(coalesce(sum(length(w[p])) FILTER (k = {k}), 0) AS BIGINT) AS in_{k}" for k in _LIMITS.coverage)}
      FROM cov JOIN w USING (r) GROUP BY r),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(in_{k}, 0) AS in_{k}" for k in _LIMITS.coverage)}
      FROM a LEFT JOIN dl USING (r) LEFT JOIN c USING (r))
SELECT *, n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.repeat_pct} * n_words AS base_failed,
       NOT (n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.repeat_pct} * n_words)
       AND dup_line_chars <= CAST({_LIMITS.line_chars} AS DOUBLE) * word_chars AND n_symbols <= CAST({_LIMITS.symbols} AS DOUBLE) * n_words AND {_COVER} AS kept FROM m""")
def _(spark, sf_dir):
    return repetition.quality(table(spark, sf_dir, "documents"))


@query("op4_url_filter")
def _(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, sample_urls.labelled(spark), **URL_FIT)


def token_length():
    from public_tokenizers import path
    return tokens.counter(path(VOCABULARY))(F.col("text")).alias("n")


def with_packing_keys(docs: DataFrame) -> DataFrame:
    """Length in tokens, and the cluster of equal texts: for the pipeline, which keeps one document of each group of
    near-duplicates. Null texts have no tokens and no cluster."""
    return docs.select("doc_id", "source", token_length(), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster"))


@query("op5_packing")
def _(spark, sf_dir):
    return packing.pack(stored(simhash.clustered(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("source"), token_length())), "n")


@query("op6_personal_data")
def _(spark, sf_dir):
    d = pii.personal_data(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", joined_digest(F.col("base")).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


@query("op7_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT r, site, line, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY r) AS pos FROM (SELECT r, site, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)),
k AS (SELECT greatest(2, least(10, (count(DISTINCT site) + 1) // 2)) AS need FROM l WHERE t <> ''),
wide AS (SELECT t FROM l, k WHERE t <> '' GROUP BY t, need HAVING count(DISTINCT site) >= CASE WHEN length(t) >= 250 THEN least(3, need) ELSE need END),
m AS (SELECT l.*, wide.t IS NOT NULL AS gone FROM l LEFT JOIN wide USING (t)),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, sum(length(line)) AS total, coalesce(sum(length(line)) FILTER (NOT gone), 0) AS stay,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS stripped FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_gone > 0 AND NOT stay < CAST(0.1 AS DOUBLE) * total THEN n_gone ELSE 0 END AS n_cut,
       coalesce(n_gone > 0 AND stay < CAST(0.1 AS DOUBLE) * total, false) AS spared,
       sha256(CASE WHEN n_gone > 0 AND NOT stay < CAST(0.1 AS DOUBLE) * total THEN stripped ELSE text END) AS text_sha256
FROM d LEFT JOIN s USING (r)""")
def _(spark, sf_dir):
    d = lines.strip_lines(table(spark, sf_dir, "documents"))
    return d.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_cut", "spared", F.sha2("text", 256).alias("text_sha256"))


@query("op8_simhash")
def _(spark, sf_dir):
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_secrets")
def _(spark, sf_dir):
    d = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", joined_digest(F.col("base")).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


@query("op10_language")
def _(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op11_html_extraction")
def _(spark, sf_dir):
    return extraction.report(table(spark, sf_dir, "pages"))


_TERMS = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_lexical_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
b AS (SELECT DISTINCT i, item_id, t FROM (SELECT i, item_id, unnest(w) AS t FROM
      (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL))),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN b USING (t) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
c AS (SELECT r, doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * big_n) // big_l))) AS v FROM p JOIN f USING (t) JOIN d USING (r), g),
s AS (SELECT i, item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM b JOIN c USING (t) GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""")
def _(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_periodic_runs")
def _(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"))

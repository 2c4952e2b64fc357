"""Personal data: fixed patterns with positions, and identifiers that only their context gives away.

Seeds are the matches of the fixed patterns. The words before a seed are a lexical pattern; patterns and instances
form a graph whose edges Spark counts over the corpus. In rounds, patterns are scored by the trust in what they
introduce, and what good patterns introduce becomes trusted in turn. Tokens with digits found after good patterns
are reported with the pattern's kind. DataFrame functions only.

Regular expressions repeat groups possessively: Java runs those in a loop, where plain groups recurse.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.store import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match starts where a run of its first class starts, or at the end of the match before (\G): an attempt from
# inside the run would need what the attempt from its start lacked.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold to be searched at all.
_HINT = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")),
         "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")}
# A candidate is a run of numbers set apart by single blanks, or else a word with a digit.
_NUMBER = r"[0-9(][0-9().-]*+(?=\p{Punct}*+(?:\s|$))"
TOKEN = rf"(?<!\S)(?:{_NUMBER}(?:\x20{_NUMBER})++|[^\s0-9]*+[0-9]\S*+)"
_SPAN = "array<struct<s:int,e:int,v:string,left:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def running_sums(lens: Column, chunk: int = 256) -> Column:
    """Running sums of an int array, by chunks so that long arrays stay cheap."""
    at = lambda i: F.floor(i / chunk).cast("int")

    def second(q: Column) -> Column:
        return F.transform(q["n"], lambda _, i: F.element_at(q["pre"], at(i) + 1) + _sum(F.slice(q["n"], at(i) * chunk + 1, i % chunk + 1)))

    def first(s: Column) -> Column:
        pre = F.transform(s["sums"], lambda _, c: _sum(F.slice(s["sums"], F.lit(1), c)))
        return let(F.struct(s["n"].alias("n"), pre.alias("pre")), second)

    chunks = lambda n: F.sequence(F.lit(0), at(F.greatest(F.size(n) - 1, F.lit(0))))
    sums = lambda n: F.transform(chunks(n), lambda c: _sum(F.slice(n, c * chunk + 1, F.lit(chunk))))
    return let(lens, lambda n: let(F.struct(n.alias("n"), sums(n).alias("sums")), first))


def found(text: Column, pattern: str, words: int = 2) -> Column:
    """Matches with code point positions and what stands before each: the pieces between the matches give both.

    Before a match stand the last ``words`` words, an earlier match of the pattern counting as the word '#'. A match
    that only blanks and punctuation part from the one before belongs to its list and has what stands before the list.
    """
    def tail(p: Column) -> Column:
        return F.reverse(F.regexp_extract(F.reverse(p), rf"^\s*+(?:\S++\s++){{0,{words - 1}}}+\S*+", 0))

    def before(x: Column, i: Column) -> Column:
        back = [c for j in range(words, 0, -1) for c in (F.get(x["t"], i - j), F.when(i >= j, "#"))]
        return F.concat_ws(" ", *back, F.get(x["t"], i))

    heads_list = lambda t, i: (i == 0) | t.rlike(r"[\p{L}\p{N}]")

    def spans(x: Column) -> Column:
        return F.transform(x["m"], lambda v, i: F.struct(
            (F.get(x["ends"], i) - F.length(v)).alias("s"), F.get(x["ends"], i).alias("e"), v.alias("v"),
            F.get(x["heads"], F.get(x["lists"], i) - 1).alias("left")))

    def placed(x: Column) -> Column:
        lens = F.transform(x["m"], lambda v, i: F.length(v) + F.length(F.get(x["p"], i)))
        lists = running_sums(F.transform(x["t"], lambda t, i: heads_list(t, i).cast("int")))
        at = F.filter(F.transform(x["t"], lambda t, i: F.when(heads_list(t, i), before(x, i))), lambda c: c.isNotNull())
        return let(F.struct(x["m"].alias("m"), running_sums(lens).alias("ends"), lists.alias("lists"), at.alias("heads")), spans)

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return let(cut, lambda x: let(F.struct(x["m"].alias("m"), x["p"].alias("p"), F.transform(x["p"], tail).alias("t")), placed))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """The usual check sum: from the right, every other digit doubled."""
    def total(r: Column) -> Column:
        def one(i: Column) -> Column:
            d = F.substr(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return F.when(d > 9, d - 9).otherwise(d)
        return _sum(F.transform(F.sequence(F.lit(1), F.length(r)), one))
    return let(F.reverse(digits(v)), total) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(v)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return F.lit(True)


def base_spans(text: Column, kind: str, words: int = 2) -> Column:
    every = F.when(_HINT[kind](text), F.filter(found(text, PATTERNS[kind], words), lambda x: _valid(kind, x["v"])))
    return F.coalesce(every, F.array().cast(_SPAN))


def context(left: Column, words: int) -> Column:
    """The last words of ``left`` in lower case, numbers as 0, a print of them if they are long; null if there are fewer."""
    w = F.filter(F.split(F.regexp_replace(F.lower(left), "[0-9]++", "0"), r"\s+"), lambda x: x != "")
    joined = let(w, lambda a: F.when(F.size(a) >= words, F.array_join(F.slice(a, -words, words), " ")))
    return let(joined, lambda c: F.when(F.length(c) > 64, F.md5(c)).otherwise(c))


@dataclass(frozen=True)
class Bootstrap:
    """A pattern needs ``seeds`` trusted values and ``precision`` of trust among all values it introduces; a value
    is trusted from ``trust`` on. Candidates are numbers, or words with a digit, of ``min_chars`` or more."""
    words: int = 2
    min_chars: int = 5
    seeds: int = 5
    precision: float = 0.6
    trust: float = 0.6


def extract(docs: DataFrame, id_col: str, text_col: str, how: Bootstrap) -> DataFrame:
    """id, print of the text, base spans of each kind, candidate tokens beside them with contexts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    d = d.select("id", F.md5("text").alias("print"), "text", *[base_spans(F.col("text"), k, how.words).alias(k) for k in KINDS])
    tokens = F.coalesce(F.when(F.col("text").rlike("[0-9]"), found(F.col("text"), TOKEN, how.words)), F.array().cast(_SPAN))
    trimmed = F.transform(tokens, lambda x: let(F.regexp_replace(x["v"], r"[\p{Punct}]++$", ""), lambda v: F.struct(
        x["s"].alias("s"), (x["s"] + F.length(v)).alias("e"), v.alias("v"), x["left"].alias("left"))))
    base = F.concat(*KINDS)
    fresh = F.filter(trimmed, lambda x: (F.length(x["v"]) >= how.min_chars) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    slim = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), context(x["left"], how.words).alias("ctx")))
    return d.select("id", "print", *[slim(F.col(k)).alias(k) for k in KINDS], slim(fresh).alias("token"))


def graph(spans: DataFrame) -> DataFrame:
    """Distinct edges ctx - value with the kind of the value, -1 for candidates."""
    def marked(no: int, col: str) -> Column:
        return F.transform(col, lambda x: F.struct(F.lit(no).alias("kind"), x["ctx"].alias("ctx"), F.lower(x["v"]).alias("v")))

    every = F.concat(*[marked(i, k) for i, k in [(-1, "token"), *enumerate(KINDS)]])
    return spans.select(F.explode(every).alias("x")).select("x.*").where("ctx is not null").distinct()


def learn(edges: DataFrame, how: Bootstrap) -> DataFrame:
    """Good patterns: ctx, kind. Each round scores patterns by trusted values, then values by patterns.
    Scores only rise from round to round, so patterns are only added; a round that adds none is the last."""
    width = edges.groupBy("ctx").agg(F.count("*").alias("n"))
    seeds = edges.where("kind >= 0").select("ctx", "kind", "v", F.lit(1.0).alias("w"))
    learnt, n_good = None, -1
    while True:
        trusted = seeds if learnt is None else seeds.unionByName(learnt)
        score = trusted.groupBy("ctx", "kind").agg(F.sum("w").alias("w"), F.count("*").alias("k"))
        # patterns with too few trusted values leave before the join: most contexts are met once
        score = score.where(F.col("k") >= how.seeds).join(width, "ctx")
        good = stored(score.withColumn("p", F.col("w") / F.col("n")).where(F.col("p") >= how.precision).select("ctx", "kind", "p"))
        n_before, n_good = n_good, good.count()
        if n_good in (0, n_before):
            return good
        tokens = edges.where("kind < 0").select("ctx", "v")
        value = (tokens.join(good, "ctx").groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("w"))
                 .where(F.col("w") >= how.trust))
        learnt = tokens.join(value, "v").select("ctx", "kind", "v", "w")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base (array of strings), spans (array of strings).

    A span is kind:start:end in code points, by kind as listed, then start. Null texts are empty. Rows with equal id
    and text get equal spans; null ids stay; other columns are not read. Very long texts and lists of matches cost by their
    length. Texts are read once; what is stored and
    shuffled are matches. One row lists the matches of one text, no group does.
    """
    spans = stored(extract(docs, id_col, text_col, how))
    good = learn(stored(graph(spans)), how)
    tokens = spans.where(F.size("token") > 0).select("id", "print", F.explode("token").alias("x")).where("x.ctx is not null")
    # a token after a context good for several kinds takes the likeliest
    best = good.groupBy("ctx").agg(F.max_by("kind", F.struct("p", -F.col("kind"))).alias("kind"))
    added = (tokens.select("id", "print", "x.s", "x.e", F.col("x.ctx").alias("ctx")).join(best, "ctx")
             .groupBy("id", "print").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more")))

    def placed(no: int, col: str) -> Column:
        return F.transform(col, lambda x: F.struct(F.lit(no).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    base = F.concat(*[placed(i, k) for i, k in enumerate(KINDS)])
    name = F.array(*map(F.lit, KINDS))
    text = lambda a: F.transform(a, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"].cast("string"), x["e"].cast("string")))
    d = spans.select(F.col("id"), F.col("print"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    more = added.select(F.col("id").alias("more_id"), F.col("print").alias("more_print"), "more")
    d = d.join(more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("print") == F.col("more_print")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,s:int,e:int>>"))))
    return d.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], text(F.col("base")).alias("base"), text(every).alias("spans"))

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, m string, id string, fp string, h string, rid string, bucket string, `count` string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source). Columns whose names clash with the operators' own come along."""
    full = [(i, t, la, s, None if t is None else len(t), *["x"] * 8) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rnd, n, words="lorem ipsum dolor sit amet the and of to in émile ça niño Straße 42 x".split()):
    out = []
    for _ in range(n):
        out.append(rnd.choice(words))
        out.append(rnd.choice([" ", " ", " ", "\n", ". ", ", ", "  "]))
    return "".join(out)


def texts(seed, n=60, longest=60):
    """Random texts with nulls, empty and blank ones, copies and repeated passages."""
    rnd = random.Random(seed)
    out = [None, "", "  \n\t ", ".", "a", "é" * 3000, "x " * 2000, "\n".join(["same line of some words"] * 30), "tab\tand\x0bvt\x0cff\rcr"]
    while len(out) < n:
        k = rnd.random()
        if k < 0.2:
            out.append(rnd.choice(out))
        elif k < 0.4:
            p = prose(rnd, 12)
            out.append(prose(rnd, 5) + p + prose(rnd, 5) + "\n" + p)
        else:
            out.append(prose(rnd, rnd.randint(1, longest)))
    return out


def rows(seed, n=60, longest=60):
    rnd = random.Random(seed + 1)
    out = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s2", "s3", None])) for i, t in enumerate(texts(seed, n, longest))]
    return out + [(None, "no id at all", "en", None), out[-1], out[-1]]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)

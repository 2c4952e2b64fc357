"""A small labelled table of URLs (1: block), built by rule from words and made-up names.

Labels go with the words alone: hosts, top-level domains, languages and path forms are dealt alike to both labels.
"""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Words by label, and what hosts and paths are put together from.
BLOCK = ("casino poker bets slots jackpot lottery win free cheap pills viagra pharmacy adult xxx porn sex escort dating spam ads adserver "
         "track tracker click popup banner loan payday giveaway replica torrent crack warez keygen phish malware farm-links miracle").split()
ALLOW = ("news school garden museum river library university health travel recipe music science history book city sport weather art film "
         "forum wiki journal office market hotel bank church park review guide research teacher doctor kitchen house family village farm").split()
SYLLABLES = ("ba che dor en fi gar hu in jo kel la mon ne ou per qua ri sto th un va wer xi yor zu ing tion ble ent ly es ed on re he an er al st "
             "ch ra lo mi to da si no te ha we ro ma pe li so be").split()
SUBS, TLDS, LANGS = ["", "www.", "m.", "blog."], ["com", "net", "org", "info", "de", "fr", "es"], ["en", "de", "fr", "es", "it"]


def _names(n: int) -> list[str]:
    """Two to four syllables each, drawn by a seeded generator."""
    rnd = random.Random(n)
    return sorted({"".join(rnd.choices(SYLLABLES, k=2 + i % 3)) for i in range(n)})


def urls(per_word: int = 10, names: int = 400, per_name: int = 4) -> list[tuple[str, int]]:
    """``per_word`` URLs for every word, ``per_name`` for every made-up name; what stands beside a word is neutral or has its label."""
    neutral = _names(names)
    out = []
    for label, words, each in ((1, BLOCK, per_word), (0, ALLOW, per_word), (0, neutral, per_name)):
        for i, w in enumerate(words):
            for k in range(each):
                own, name = words[(i * 5 + k * 7 + 1) % len(words)], neutral[(i * 3 + k * 13) % len(neutral)]
                host = [w, f"{w}-{own}", f"{name}-{w}", f"{w}{k}", f"{w}.{name}"][(i + k) % 5 if each < 5 else k % 5]
                tail = ["", ".html", "/", f"/{own}", ".php"][(i + k) % 5]
                path = f"/{LANGS[(i + 2 * k) % 5]}/{(i * 37 + k * 101) % 9973}{tail}"
                if k % 10 == 9:
                    host, path = name, f"/{w}{path}"
                out.append((f"http://{SUBS[(i + k // 2) % 4]}{host}.{TLDS[(i * 2 + k * 3) % 7]}{path}", label))
    return out


def labelled(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    return spark.createDataFrame(urls() if rows is None else rows, "url string, label int")

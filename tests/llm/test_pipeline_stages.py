"""Single stages of the pipeline against plain versions of them."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lotquery.llm.common import share, table

from . import test_registered
from .conftest import rows
from .test_near_dedup import brute as components

STAGES = dict(corpus_pipeline.STAGES)


def test_near_copies_from_80_percent_go(spark):
    def text(group: int, shared: int, own: int) -> str:  # of shared + own shingles
        return " ".join([f"w{group}x{k}" for k in range(shared + 4)] + [f"own{group}y{own}z{k}" for k in range(own)])

    texts = {}
    for group, own in enumerate((26, 25, 24, 20, 18, 17, 16, 1)):  # 100 shared of 100 + own: 0.794, 0.8 and more
        texts |= {10 * group + 1: text(group, 100, 0), 10 * group + 2: text(group, 100, own)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in rows(STAGES["near_dedup"](spark, docs, ""))}
    assert kept == set(components(texts, 80).values()) == {*range(1, 80, 10), 2}


OTHERS = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由，在尊严和权利上一律平等。",
    "asdf jkl qwer zxcv uiop hjkl fghj vbnm xcvb dfgh",
    "x", "9 $ Ж",
]


def test_unknown_languages_and_junk_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (5, 60, 900)]
    given = table(spark, test_registered.SF, "documents")
    clean = [r["text"] for r in rows(given.filter(share(F.col("doc_id"), 4) == 2))]
    # Short pieces of texts that the stage doesn't learn from, and such texts in turn.
    short = [" ".join(t.split()[:n]) for t, n in zip(clean, [1, 2, 3, 5, 8] * 20)]
    short = [t for t in short if any(c.isalpha() for c in t)]
    both = [f"{a} {b}" for a, b in zip(clean[::2], clean[1::2])]
    texts = OTHERS + junk + short + both
    more = spark.createDataFrame([(10 ** 6 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], given.schema)
    left = STAGES["language_id"](spark, given.unionByName(more), "").filter(F.col("doc_id") >= 10 ** 6)
    gone = len(OTHERS) + len(junk)
    assert {r["doc_id"] - 10 ** 6 for r in rows(left)} == set(range(gone, len(texts)))

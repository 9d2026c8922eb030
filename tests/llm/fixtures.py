"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def edited(text: str, every: int) -> str:
    words = text.split(" ")
    words[::every] = [f"changed{i}" for i in range(len(words[::every]))]
    return " ".join(words)


LONG = prose(99, 20_000)
ROWS = [
    (1, prose(1, 200)), (2, prose(1, 200)), (3, prose(1, 200).upper()), (4, edited(prose(1, 200), 150)), (5, edited(prose(1, 200), 10)),
    (6, prose(6, 120)), (7, None), (8, ""), (9, " \n\t"), (10, "one"), (11, "one"), (12, "one two three"), (13, LONG), (14, LONG + " end"),
    (15, prose(15, 80)), (15, prose(15, 80)), (16, prose(16, 70)), (None, prose(17, 90)), (None, prose(17, 90)), (18, "naïve ＷＩＤＥ 你好 😀 ▁x  y\u0000z"),
    (19, "Write to jane.doe@mail.example.org, or call +1 (555) 010-4477 today. " + prose(19, 60)), (20, "x" * 3000 + "@" + "y" * 50),
]


def documents(spark, extra: bool = True):
    """The rows with columns named like the operators' own results."""
    rows = [(d, t, "en", "src0", len(t or "")) for d, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.selectExpr("*", "1 AS row", "true AS kept", "'x' AS set_id", "0.5D AS score", "'y' AS component_id", "2 AS n_words")
        df = df.withColumn("term.x", F.lit(1))
    return df


def no_documents(spark):
    return documents(spark, False).limit(0)

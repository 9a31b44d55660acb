"""Language models learn from whole texts of the rows they sample."""

import random

from pyspark.sql import functions as F

from factloom.llm import language

WORDS = {"en": ["the", "and", "thing", "which"], "fr": ["leur", "que", "nous", "avec"]}


def test_language_learns_past_a_shared_opening(spark):
    rng = random.Random(8)
    opening = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(500))  # 3,499 characters
    rows = [(2 * i + j, f"{opening} {' '.join(rng.choices(w, k=60))} last{'abcdefghij'[i % 10] * (i // 10 + 1)}", k) for i in range(90) for j, (k, w) in enumerate(WORDS.items())]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    whole = [t in m.text[k] for _, t, k in rows]  # but for those that set the limit
    assert sum(whole) == len(rows) * (language.CALIBRATED - 1) / language.CALIBRATED
    new = spark.createDataFrame([(1, "the thing and the thing which"), (2, "que leur nous avec que")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(new, m).collect()} == {1: "en", 2: "fr"}

"""What is fitted and voted on takes in every document and record."""

import pytest

from lodestone.llm import language, reading_level


def test_sentences_are_fitted_on_every_text_and_grade(spark, monkeypatch):
    """F8: 25,000 texts, 22,000 of them graded: a classifier fitted on a sample of 20,000 would see fewer."""
    docs = spark.range(25_000).selectExpr("id doc_id", "concat('text ', id) text")
    labels = spark.range(22_000).selectExpr("id doc_id", "'r' rater", "cast(1 + id % 4 as int) reading_level")
    seen = []

    def fit(graded, texts):
        seen.extend([graded.count(), texts.count()])
        raise StopIteration

    monkeypatch.setattr(reading_level, "fit_sentences", fit)
    with pytest.raises(StopIteration):
        reading_level.reading_scores(docs, labels)
    assert seen == [22_000, 25_000]


def test_split_of_counted_scores():
    import numpy as np

    x = np.array([-3.0, -2.9, -1.0, -0.9, -0.8])
    assert language.split(x) == language.split(x[[4, 0, 2, 1, 3]], np.ones(5)) == pytest.approx(-1.95)

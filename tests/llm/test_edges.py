"""Edge cases of the learned operators: clashing columns, empty tables, very long texts."""

from shale.llm import op4_toxicity as tox
from shale.llm import op9_language as ppm


def test_toxicity_of_any_table(spark):
    model = ({"idiot": 3.0}, [], [4.0, 1.0, -2.0])
    long_text = "fine words " * 200_000 + "idiot"
    rows = [(1, long_text, 9.0, "r", "b", "p"), (2, "idiot idiot", None, None, None, None), (2, "idiot idiot", None, None, None, None), (None, None, 1.0, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _row string, batch string, predicted string")
    got = tox.score(docs, model)
    assert got.columns == ["doc_id", "_row", "batch", "predicted", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 3 and got.count() == 4 and by[1]._row == "r" and by[None].predicted == "z"
    assert by[2].score > 0.9 > 0.5 > by[None].score and by[1].score < by[2].score
    assert tox.score(docs.limit(0), model).count() == 0 and tox.score(docs, ({}, [], [])).count() == 4


def test_language_of_any_table(spark):
    train = spark.createDataFrame([(i, "the cat and the dog " * 9 if i % 2 else "le chat et le chien " * 9, "en" if i % 2 else "fr") for i in range(20)], "doc_id long, text string, lang string")
    stats = ppm.learn(train)
    docs = spark.createDataFrame([(1, "the dog " * 100_000, "a", 7, "b"), (2, None, None, None, None), (2, None, None, None, None), (3, "123 !", "x", 1, "y")], "doc_id long, text string, lang_pred string, score int, _row string")
    got = ppm.predict(docs, stats)
    assert got.columns == ["doc_id", "_row", "lang_pred", "score"]
    assert sorted((r.doc_id, r._row, r.lang_pred) for r in got.collect() if r.doc_id != 2) == [(1, "b", "en"), (3, "y", "und")]
    assert ppm.predict(docs.limit(0), stats).count() == 0
    none = ppm.learn(train.limit(0))
    assert none is None and {r.lang_pred for r in ppm.predict(docs, none).collect()} == {"und"}

import zlib
from pathlib import Path

import numpy as np
import pytest

from panelkit.llm import quality
from panelkit.llm.quality import FEATURES, AdditiveModel, text_features

DATA = Path("/root/testdata/sf0.01")


def test_additive_shape_and_interaction_are_learned():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 3))
    y = (np.abs(x[:, 0]) > 0.8) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))
    plain = AdditiveModel.fit(x[:3000], y[:3000].astype(float), n_pairs=0)
    paired = AdditiveModel.fit(x[:3000], y[:3000].astype(float), n_pairs=3)
    right = [((m.score(x[3000:]) > 0.5) == y[3000:]).mean() for m in (plain, paired)]
    assert right[1] > right[0] and right[1] > 0.8 and (2, 1) in paired.pairs


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    model = AdditiveModel.fit(x, (x[:, 0] > 0).astype(float), n_pairs=1, rounds=20)
    for row, got in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.base + sum(t[int((e <= v).sum())] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[int((model.pair_edges[i] <= row[i]).sum()), int((model.pair_edges[j] <= row[j]).sum())]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_no_rows_and_one_class():
    assert AdditiveModel.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == pytest.approx(0.5)
    assert AdditiveModel.fit(np.zeros((50, 2)), np.ones(50)).score(np.zeros((1, 2)))[0] > 0.9


def test_features_of_small_texts():
    rows = dict(zip(FEATURES, text_features([b"The the the A\nThe the the A\n|x 12", b""])[0], strict=True))
    assert rows["distinct_lines"] == pytest.approx(2 / 3) and rows["distinct_words"] == pytest.approx(5 / 10)
    assert rows["repeated_neighbours"] == pytest.approx(2 / 10) and rows["top_word"] == pytest.approx(4 / 10)
    assert rows["longest_word"] == 3 and rows["upper_of_letters"] == pytest.approx(4 / 21)
    assert not text_features([b""]).any() and text_features([]).shape == (0, len(FEATURES))


def test_features_do_not_depend_on_the_batch():
    texts = [b"one two two", b"", "é è | x".encode(), b"a " * 5000]
    together = text_features(texts)
    assert all(np.allclose(text_features([t])[0], row) for t, row in zip(texts, together, strict=True))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).toPandas()
    assert len(got) == docs.count()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.93
    assert both.predicted[both.quality == 1].mean() > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() == int(got.predicted.sum())


def test_edge_rows(documents, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, None), (4, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "good words here"), (2, "###"), (2, "###"), (3, None), (4, ""), (None, "x"), (6, "long " * 200_000)])
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[3] == by[4] and len(by[2]) == 1
    assert quality.score_documents(documents([]), model).count() == 0 and quality.keep_good(documents([]), model).count() == 0
    assert quality.train(documents([]), labels.limit(0)).score(np.zeros((1, len(FEATURES))))[0] == pytest.approx(0.5)


def test_training_is_the_same_where_a_doc_id_has_two_texts(spark, documents):
    rows = [(i, f"word{i % 7} " * (5 + i % 11) + "and. So it is." * (i % 3)) for i in range(60)] + [(i, "x1 y2 z3 " * (3 + i % 4)) for i in range(0, 60, 2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = []
    for order in (1, -1):
        model = quality.train(documents(rows[::order], parts=1 + (order > 0) * 4), labels)
        scores.append([r.score for r in quality.score_documents(documents(rows), model).orderBy("doc_id", "score").collect()])
    assert scores[0] == scores[1]

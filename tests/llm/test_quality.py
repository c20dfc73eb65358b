import zlib

import numpy as np
import pyarrow as pa
from conftest import EDGES

from prepflow.llm import quality


def test_pairs_are_ordered():
    rng = np.random.default_rng(0)
    good = rng.random(400) < 0.8
    x = rng.normal(size=(400, 5))
    x[:, 2] += 3 * good
    model = quality.fit(x, good, pairs=5_000)
    shown = model.shown(x)
    wrong = (shown[good][:, None] <= shown[~good]).mean()
    assert wrong < 0.03 and ((shown >= quality.CUT) == good).mean() > 0.95
    assert 0 <= shown.min() and shown.max() <= 1
    again = quality.fit(x, good, pairs=5_000)
    assert (again.weights == model.weights).all()


def test_gradient_vanishes_at_the_fit():
    """The weights solve the penalised Bradley-Terry likelihood of the pairs."""
    x = np.array([[1.0], [2.0], [0.0], [0.5]])
    model = quality.fit(x, np.array([True, True, False, True]), pairs=4)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    z = np.concatenate([z, z * z], axis=1)
    rng = np.random.default_rng(7)
    better = np.concatenate([rng.permutation([0, 1, 3]) for _ in range(2)])[:4]
    worse = np.array([2, 2, 2, 2])
    d = z[better] - z[worse]
    p = 1 / (1 + np.exp(d @ model.weights))
    assert np.abs(d.T @ p / 4 - quality.RIDGE * model.weights).max() < 1e-5


def test_features_are_finite_and_empty_is_zero():
    texts = [t or "" for _, t in EDGES] + ["\n\n", "!!! ### |", "Ünï çødé 文字"]
    rows = quality.Featurizer()(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    assert rows.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(rows).all()
    assert (rows[[0, 1, 2]] == 0).all()
    one = quality.Featurizer()(pa.RecordBatch.from_arrays([pa.array(texts[5:6])], names=["text"]))
    assert (one[0] == rows[5]).all()


def _labelled(spark, clash, n=160):
    docs = [(i, f"Plain words follow each other here, number {i}, and stop." if i % 4 else f"BUY!! ### NOW!! $$$ {i} ||| !!") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)] + [(3, 0), (None, 1), (5, None), (7, 9)], "doc_id bigint, quality int")
    return clash(docs + EDGES[:1] + [(9_000, None), (9_001, "x" * 100_000), (1, "repeated id")]), labels


def test_classify(spark, clash):
    docs, labels = _labelled(spark, clash)
    found = quality.classify(docs, labels).collect()
    assert len(found) == 164 and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    clear = [r for r in found if r["doc_id"] is not None and 1 < r["doc_id"] < 160]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in clear]) > 0.97


def test_held_out_labels_teach_nothing(spark, clash):
    docs, labels = _labelled(spark, clash)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_nothing_to_learn_from(spark, clash):
    docs, labels = _labelled(spark, clash)
    assert {r["predicted"] for r in quality.classify(docs, labels.limit(0)).collect()} == {1}
    assert {r["predicted"] for r in quality.classify(docs, labels.where("quality = 0")).collect()} == {1}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet")
    found = quality.classify(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id")
    assert found.selectExpr("avg(cast(predicted = quality as double))").first()[0] > 0.95


def test_every_labelled_document_is_learned_from(spark, clash, monkeypatch):
    """The means are those of all labelled documents, and a rare label meets every block of the other one."""
    docs, labels = _labelled(spark, clash)
    whole = quality.train(docs, labels)
    monkeypatch.setattr(quality, "BLOCK", 4)
    dealt = quality.train(docs, labels)
    assert np.allclose(dealt.mean, whole.mean) and np.allclose(dealt.scale, whole.scale)
    again = quality.train(docs.repartition(5), labels)
    assert (dealt.weights == again.weights).all() and dealt.threshold == again.threshold
    rare = labels.where("quality = 1 or doc_id = 4")
    model = quality.train(docs, rare)
    assert np.isfinite(model.weights).all() and model.weights.any()


def test_blocks_agree_with_one_fit(spark, monkeypatch):
    """More documents than a block holds: as good as a fit on all rows at once, with the exact threshold of its scores."""
    monkeypatch.setattr(quality, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "!!", "##", "gamma."], 30, p=p)), good) for i, good in enumerate(rng.integers(0, 2, 600).tolist())
            for p in ([[0.4, 0.2, 0.1, 0.1, 0.2], [0.2, 0.2, 0.25, 0.25, 0.1]][1 - good],)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(used) > 4 * 50
    x = quality.Featurizer()(pa.RecordBatch.from_arrays([pa.array([r[1] for r in used])], names=["text"]))
    good = np.array([r[2] == 1 for r in used])
    # the pair at a document's end depends on its neighbour in the batch
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-3) and np.allclose(model.spread, model.raw(x).std(), rtol=1e-2)
    one = quality.fit(x, good)
    errors = lambda m, at: int(((m.raw(x) >= at) != good).sum())
    least = min(errors(model, at) for at in [*(model.raw(x) - 1e-9), np.inf])
    assert errors(model, model.threshold) <= least + 3
    assert errors(model, model.threshold) <= errors(one, one.threshold) + 10

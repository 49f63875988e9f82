import random

import numpy as np
import pytest

from tests.llm.conftest import make_docs
from tidelog.llm import quality_model as q


def corpus(n=300):
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefghilmnorstu", k=r.randint(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for k in range(n):
        words = r.choices(vocab, k=r.randint(3, 120))
        good = k % 4 != 0
        if not good:
            words = r.choice([lambda w: [x + r.choice(["***", "%%"]) for x in w], lambda w: [x.upper() + "!!" for x in w], lambda w: [x for x in w for _ in range(4)]])(words)
        texts.append(" ".join(words))
        labels.append((k, int(good), 0))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    df, lab = make_docs(spark, texts, extra=("score", "y")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = q.score(df, lab).withColumn("h", q.held_out()).collect()
    held = [r for r in rows if r.h]
    assert len(rows) == len(texts) and len(held) > 60
    assert np.mean([(r.score >= 0.5) == labels[r.doc_id][1] for r in held]) > 0.95
    kept = q.keep_good(df, lab)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.5}


def test_labels_of_held_out_rows_do_not_matter(spark):
    texts, labels = corpus(60)
    df = make_docs(spark, texts)
    held = {r.doc_id for r in df.where(q.held_out()).collect()}
    a = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, 1 - y if i in held else y, 1) for i, y, _ in labels], "doc_id long, quality int, toxic int")
    assert sorted(q.score(df, a).collect()) == sorted(q.score(df, b).collect())


def test_density_difference():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (200, 3)), r.normal(2, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    m = q.Discriminant.fit(x, y, shrink=0.0, ridge=0.0)
    z, want = (x - m.centre) / m.scale, []
    for k in (0, 1):
        cov = np.cov(z[y == k].T, bias=True)
        d = z - z[y == k].mean(0)
        want.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(want[0] - want[1])))


def test_awkward_rows(spark, prose):
    df = make_docs(spark, prose)
    for labels, want in (([], 0.5), ([(0, 1, 0), (2, 1, 0)], 1.0), ([(0, None, 0), (2, 7, 1), (None, 1, 0)], 0.5)):
        rows = q.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == len(prose) and {r.score for r in rows} == {want}
    texts, labels = corpus(80)
    lab = spark.createDataFrame([*labels, *labels[:9]], "doc_id long, quality int, toxic int")
    rows = q.score(make_docs(spark, texts + prose), lab).collect()
    assert len(rows) == len(texts + prose) and all(0 <= r.score <= 1 for r in rows)
    assert q.score(df.limit(0), lab).collect() == []
    assert all(np.isfinite(q.features((t or "").encode())).all() and len(q.features((t or "").encode())) == q.N_FEATURES for t in prose)


def test_sample_bounds_what_is_fitted(spark, monkeypatch):
    texts, labels = corpus(200)
    seen = []
    fit = q.Discriminant.fit.__func__
    monkeypatch.setattr(q.Discriminant, "fit", classmethod(lambda cls, x, y: seen.append(len(x)) or fit(cls, x, y)))
    q.fit(make_docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=50)
    assert seen == [50]

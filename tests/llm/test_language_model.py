import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import make_docs
from tidelog.llm import language_model as lm


def split(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b""]


def test_base_and_model_against_brute_force(spark, prose):
    ids = [*range(len(prose) - 1), None]
    train = [t for i, t in zip(ids, prose) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in lm.score(make_docs(spark, prose, ids, extra=("key", "word", "c"))).collect()}
    model, counts = lm.fit(make_docs(spark, prose, ids))
    assert {bytes(r.word): r.c for r in counts.collect()} == dict(c)
    assert (model.n_tokens, model.n_words) == (n, v)
    single = {w: k for k, w in enumerate(model.single)}
    kind = lambda w: single.get(w, lm.SINGLE + lm._ending(w) if w not in single else None)
    for i, t in zip(ids, prose):
        words, r = split(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in c for w in words), n)
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        a = b = lm.START
        want = 0.0
        for w in words:
            k = kind(w)
            want += float(model.table[a * lm.HISTORIES + b, k]) + math.log10((c[w] + 1) / model.norms[k])
            a, b = k, a
        assert r.score == pytest.approx(want)


def test_model_is_a_distribution(spark, prose):
    model, counts = lm.fit(make_docs(spark, prose))
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-4)
    mass = np.zeros(lm.CLASSES)
    lexicon = lm.Lexicon([], model.single)
    for r in counts.collect():
        k = lexicon.kind[lexicon.numbers([bytes(r.word)])[0]]
        mass[k] += (r.c + 1) / model.norms[k]
    assert (mass < 1 + 1e-9).all() and mass[: len(model.single)] == pytest.approx(1)


def test_gradient_is_the_slope():
    r = np.random.default_rng(1)
    history, counts = np.array([0, 5, 700]), r.integers(0, 9, (3, lm.CLASSES)).astype(float)
    w = lm.Weights(r.normal(size=lm.CLASSES), r.normal(size=(lm.HISTORIES, lm.CLASSES)), r.normal(size=(lm.HISTORIES, lm.CLASSES)))
    value, g = lm.gradient(w, history, counts)
    for row, col in ((0, 3), (1, 5), (1 + 700 // lm.HISTORIES, 9), (1 + lm.HISTORIES + 5, 1)):
        step = np.zeros_like(g)
        step[row, col] = 1e-5
        assert (lm.gradient(w.moved(step), history, counts)[0] - value) / 1e-5 == pytest.approx(g[row, col], abs=1e-2)


def test_learns_from_the_history(spark):
    texts = ["le chat le chien le chat le loup " * 5, "the cat the dog the cat the wolf " * 5] * 20
    rows = lm.score(make_docs(spark, texts)).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.score > r.base_score + 5 for r in held)


def test_lexicon_is_bounded(monkeypatch):
    monkeypatch.setattr(lm, "REMEMBERED", 5)
    lexicon = lm.Lexicon([(b"a", 9)], [b"", b"a"])
    for k in range(50):
        assert lexicon.numbers([b"a", b"w%d" % k]).tolist()[0] == 0
        assert len(lexicon.words) <= 8


def test_empty(spark):
    assert lm.score(make_docs(spark, ["a"]).limit(0)).collect() == []
    r = lm.score(make_docs(spark, ["a b", None], [None, None])).collect()
    assert [x.base_score for x in r] == [0.0, 0.0] and all(x.train_tokens == 0 and x.n_known == 0 and x.score < 0 for x in r)


def test_hashed_model_against_brute_force(spark, prose):
    ids = [*range(len(prose) - 1), None]
    model, counts = lm.fit(make_docs(spark, prose, ids), hashed=True)
    c = {bytes(r.word): r.c for r in counts.collect()}
    single, m = {w: k for k, w in enumerate(model.single)}, model.hashed
    assert m.weights.any()

    def place(f, name, half):
        return ((((f ^ (name * 0x9E3779B97F4A7C15 % 2**64)) * 0xFF51AFD7ED558CCD) % 2**64) >> (65 - lm.WEIGHT_BITS)) + half * 2 ** (lm.WEIGHT_BITS - 1)

    def down(leaf, n, base, f, first, half):
        out, node = 0.0, 1
        while node < n:
            right = leaf * 2 // n % 2 if node == 1 else (leaf >> (n.bit_length() - 1 - node.bit_length())) & 1
            x = float(base[node]) + sum(float(m.weights[place(g, first + node, half)]) for g in f)
            out -= math.log10(1 + math.exp(-x if right else x))
            node = 2 * node + right
        assert node == n + leaf
        return out

    rows = {r.doc_id: r.score for r in lm.score(make_docs(spark, prose, ids), hashed=True).collect()}
    for i, t in list(zip(ids, prose))[::3]:
        words = split(t)
        if len(words) > 500:
            continue
        codes = [1, 1] + [xxhash.xxh64_intdigest(w, 42) for w in words]
        f = lm.features(np.array(codes[2:], np.uint64))
        a = b = lm.START
        want = 0.0
        for at, w in enumerate(words):
            k, g = single.get(w, lm.SINGLE + lm._ending(w)), (codes[at + 2] >> 32) % lm.INNER
            mine = [int(x) for x in f[:, at]]
            want += down(k, lm.CLASSES, m.outer[a * lm.HISTORIES + b], mine, 0, 0)
            if w in single:
                want += math.log10((c.get(w, 0) + 1) / model.norms[k])
            else:
                want += down(g, lm.INNER, m.inner[k - lm.SINGLE], mine[:1], (1 + k) * lm.CLASSES, 1)
                want += math.log10((c.get(w, 0) + 1) / model.inner[k - lm.SINGLE, g])
            a, b = k, a
        assert rows[i] == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_hashed_model_is_a_distribution():
    r = np.random.default_rng(3)
    rows = lambda n, k: r.dirichlet(np.ones(k), n)
    p, q = rows(lm.HISTORIES**2, lm.CLASSES), rows(lm.ENDINGS, lm.INNER)
    f = lm.features(np.array([5, 6, 7], np.uint64))[:, 2:]
    # every class, and every group of one class, after the same history
    codes = np.arange(lm.INNER, dtype=np.uint64) << np.uint64(32)
    for weights, exact in ((np.zeros(1 << lm.WEIGHT_BITS, np.float32), True), (r.normal(size=1 << lm.WEIGHT_BITS).astype(np.float32), False)):
        m = lm.Hashed(lm.odds(p), lm.odds(q), weights)
        for k in (lm.SINGLE, lm.CLASSES - 1):
            one = 10 ** m.log10(np.full(lm.INNER, k), codes, np.full(lm.INNER, 9), np.repeat(f, lm.INNER, 1))
            if exact:
                assert one == pytest.approx(p[9, k] * q[k - lm.SINGLE], rel=1e-4)
        total = sum((10 ** m.log10(np.full(lm.INNER, k), codes, np.full(lm.INNER, 9), np.repeat(f, lm.INNER, 1))).sum() / (lm.INNER if k < lm.SINGLE else 1) for k in range(lm.CLASSES))
        assert total == pytest.approx(1)


def test_real_words_before_count_in_both_factors(spark):
    # all first words of a pair are of one class, and so are all second ones
    r, texts = random.Random(4), []
    filler = [f"w{k}" for k in range(70)]
    for _ in range(150):
        words = []
        for _ in range(40):
            pair = r.randrange(8)
            words += [r.choice(filler), r.choice(filler), r.choice(filler), r.choice(filler), f"{pair}ing", f"{pair}ism"]
        texts.append(" ".join(words))
    texts = [" ".join(filler * 12) + " " + t for t in texts]
    docs = make_docs(spark, texts)
    classes_only = {x.doc_id: x.score for x in lm.score(docs).collect()}
    held = [x for x in lm.score(docs, hashed=True).collect() if x.held_out]
    assert held and all(x.score > classes_only[x.doc_id] + 10 for x in held)


def test_texts_are_looked_up_together(prose):
    """Each word of some texts is looked up once, whatever separates them, and no token, start or history is lost."""
    texts = [(t or "").encode() for t in prose] + [b"  a\tB\x0bb\x0c\r\n a ", b"\x1c\xc2\xa0 \xc2\x85", b"", b" "]
    distinct, which, starts = lm.laid(texts)
    assert len(set(distinct)) == len(distinct) and which.max() < len(distinct)
    got = [[distinct[i] for i in w.tolist()] for w in np.split(which, starts[1:])]
    assert got == [lm.tokens(t) for t in texts]
    lexicon = lm.Lexicon([(b"a", 9), (b"", 3)], [b"", b"a"])
    own = [lexicon.numbers(lm.tokens(t)) for t in texts]
    k, codes = lexicon.classes(np.concatenate(own)), lexicon.codes(np.concatenate(own))
    assert lm.histories(k, starts).tolist() == [h for x in own for h in lm.histories(lexicon.classes(x)).tolist()]
    assert lm.features(codes, starts).tolist() == np.concatenate([lm.features(lexicon.codes(x)) for x in own], 1).tolist()
    kinds, found, logs = lexicon.look_up(distinct)
    assert (kinds[which] == k).all() and (found[which] == codes).all() and [w for w, x in zip(distinct, logs) if x == x] == [w for w in distinct if w in (b"a", b"")]
    column = pa.array(texts, pa.binary())
    assert [t for some in lm._slices(column) for t in some] == texts and list(lm._slices(column.slice(0, 0))) == []

import random
from collections import Counter

import pytest

from tests.llm.conftest import make_docs
from tidelog.llm import substrings


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"v{k}" for k in range(40)] + ["é", "A", "a"]
    shared = [r.choices(vocab, k=r.randint(5, 30)) for _ in range(4)]
    out = []
    for k in range(60):
        words = r.choices(vocab, k=r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(shared)
        if k % 7 == 0:
            words += ["x"] * r.randint(0, 30) + ["p", "q"] * r.randint(0, 20)
        out.append(("\n" if k % 2 else "  ").join(words))
    return out + out[:3] + [None, "", " \t", "one", "x " * 50]


@pytest.mark.parametrize("window,gram,bits,crowd", [(8, 3, 27, 20_000), (8, 2, 6, 3), (5, 5, 10, 1), (12, 1, 20, 50)])
def test_equals_brute_force(spark, window, gram, bits, crowd):
    texts = corpus(window)
    df = make_docs(spark, texts, extra=("spans", "th", "mini")).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, window, gram=gram, cell_bits=bits, crowd=crowd).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_production_parameters(spark, prose):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(make_docs(spark, prose)).collect()}
    assert got == dict(enumerate(brute(prose, 35)))


def test_equal_ids_and_empty(spark):
    text = " ".join(map(str, range(50)))
    df = make_docs(spark, [text, text, "other", None], [1, 1, None, None])
    assert sorted(r.n_removed for r in substrings.remove_repeats(df).collect()) == [0, 0, 50, 50]
    assert substrings.remove_repeats(df.limit(0)).collect() == []
    alone = make_docs(spark, [text], [None])
    assert [r.n_removed for r in substrings.remove_repeats(alone).collect()] == [0]


def test_long_runs_of_few_words(spark, monkeypatch):
    """Texts whose windows all have one minimiser: their strings stay short, and so does what a task holds."""
    monkeypatch.setattr(substrings, "LONGEST", 16)
    texts = ["a " * 900, "b a " * 300, "a b " * 200 + "c", "a " * 34, "c " * 35, "c " * 30 + "d", None]
    for t in texts[:3]:
        w = substrings.Windows(t.encode(), 35, 5)
        assert w.count.max() <= 16 and w.count.sum() == len(t.split()) - 34 and (w.first[1:] == w.first[:-1] + w.count[:-1]).all()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(make_docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts, 35)))

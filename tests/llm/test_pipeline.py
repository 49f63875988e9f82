import random

import corpus_pipeline as cp
import public_tokenizers
import pyspark.sql.functions as F
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from tokenizers import Tokenizer

from tests.llm.conftest import make_docs
from tests.llm.test_contamination import lower
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tidelog.llm import common, contamination, packing, quality_model


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small sf_dir: prose, junk with labels, copies, near copies, shared lines, benchmark passages."""
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdefghilmnorstu", k=r.randint(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(r.choices(vocab, k=n))
    texts = ["\n".join(line(r.randint(5, 40)) for _ in range(r.randint(1, 6))) for _ in range(120)]
    good = [True] * len(texts)
    for k in range(40):
        words = line(60).split()
        texts.append(" ".join(r.choice([[w + "***" for w in words], [w.upper() + "!!" for w in words], [w for w in words for _ in range(4)]])))
        good.append(False)
    items = [line(30) for _ in range(5)]
    long = line(400)
    texts += [f"{line(60)}\n{line(20)} {items[0]} {line(20)}", items[1], texts[3], f"{texts[4]}\n{line(300)}", long, long.replace(vocab[3], vocab[4], 1) + " x", None, "", "a"]
    good += [True] * (len(texts) - len(good))
    order = list(range(len(texts)))
    r.shuffle(order)
    texts, good = [texts[k] for k in order], [good[k] for k in order]
    top = tmp_path_factory.mktemp("sf")
    make_docs(spark, texts).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good) if k % 2 or not g], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top), texts, good, items


def test_stages_follow_the_contract():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-duplicate removal", "benchmark decontamination", "packing"]


def test_run_equals_brute_force(spark, corpus):
    top, texts, good, items = corpus
    labels = spark.read.parquet(f"{top}/labels.parquet")
    docs = spark.read.parquet(f"{top}/documents.parquet")
    scores = {x.doc_id: x.score for x in quality_model.score(docs, labels).collect()}
    kept = [k for k in range(len(texts)) if scores[k] >= 0.5]
    assert sum((scores[k] >= 0.5) == good[k] for k in range(len(texts))) > 0.97 * len(texts)
    lines = {d: t for d, t, _, _ in brute_lines([texts[k] for k in kept], kept)}
    fps = {d: brute_fingerprint(t) for d, t in lines.items()}
    group = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    alone = {d: lines[d] for d in lines if group[d] == d}
    automaton = contamination.SuffixAutomaton([(str(k), contamination.words_of(t.encode())) for k, t in enumerate(items)])
    clean = {}
    for d, t in alone.items():
        n, spans, _ = contamination.match(automaton, (t or "").encode())
        if sum(b - a for a, b in spans) <= 0.8 * n:
            clean[d] = contamination.without((t or "").encode(), spans).decode() if spans else t
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    rows = cp.run(spark, top).collect()
    got = {}
    for x in rows:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
        assert x.doc_tokens == want[x.doc_id]
    assert got == want
    assert all(lower(items[0]) not in lower(t) for t in clean.values())


def test_stages_keep_columns_and_take_awkward_tables(spark, corpus):
    top = corpus[0]
    docs = spark.read.parquet(f"{top}/documents.parquet").withColumn("spans", F.lit("x")).withColumn("score", F.lit(1)).withColumn("kept", F.lit(True))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, top)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), top).collect() == [], name
        twice = stage(spark, docs.limit(5).union(docs.limit(5)).withColumn("doc_id", F.lit(None).cast("long")), top)
        assert twice.count() <= 10, name
    assert cp.STAGES[-1][1](spark, docs.limit(0), top).collect() == []


def test_changed_texts_are_counted_anew(spark, corpus):
    top = corpus[0]
    docs = spark.read.parquet(f"{top}/documents.parquet")
    out = cp.lines(spark, docs, top)
    assert out.where("n_chars <> coalesce(length(text), 0)").count() == 0 and out.count() == docs.count()


def test_workers_hold_one_operators_memory(spark, corpus, monkeypatch):
    """What an operator keeps in a Python worker goes with the first task of another one, in every stage that has Python workers."""
    owners, plain = [], DataFrame.mapInArrow

    def spy(df, func, *more, **options):
        assert func.func is common._lean
        owners.append(func.args[1])
        return plain(df, func, *more, **options)

    monkeypatch.setattr(DataFrame, "mapInArrow", spy)
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(3)
    for _, stage in cp.STAGES:
        stage(spark, docs, corpus[0])
    assert set(owners) == {"quality_model", "simhash", "contamination", "packing"}
    packing.tokenizer_at(None)
    assert list(common.lean(iter, "packing")(iter([1, 2]))) == [1, 2] and common.kept("packing")
    assert list(common.lean(iter, "quality_model")(iter([1, 2]))) == [1, 2] and not common.kept("packing")

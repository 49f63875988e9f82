import random
import re

import duckdb

from tests.llm.conftest import make_docs
from tidelog.llm import quality_rules as q

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def cases(prose):
    r = random.Random(3)
    many = " ".join(r.choices([f"w{k}" for k in range(60)], k=1500))  # more than 32 kinds of repeated windows
    twice = " ".join(f"u{k}" for k in range(200))
    short = [t for t in prose if t is None or len(t) < 9000]
    return [*short, many, f"{twice} {twice}", "a b c a b c a", "a a a", "a a", "x\n\nx\n x\nx", "- a\n* b\n• c\nd...\ne…", " ".join(["the of and word"] * 3 + [f"z{k}" for k in range(60)])]


def test_base_columns_and_sql(spark, prose):
    texts = cases(prose)
    df = make_docs(spark, texts, extra=("w", "h", "s", "d", "t", "p", "lines", "kept"))
    rows = {r.doc_id: r for r in q.judge(df).collect()}
    assert {i: tuple(rows[i][c] for c in BASE) for i in rows} == {i: brute(t) for i, t in enumerate(texts)}
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  read by name below
    got = duckdb.sql(q.sql()).fetchall()
    assert sorted(got) == sorted(tuple(rows[i][c] for c in ["doc_id", *BASE, "kept"]) for i in rows)


def test_verdicts(spark):
    plain = " ".join(f"word{k} the" if k % 4 else f"und{k} of" for k in range(60))
    texts = [plain, plain.replace(" ", "*** "), " ".join(["- x y z the of"] * 30), None, "short the of"]
    assert {r.doc_id: r.kept for r in q.judge(make_docs(spark, texts)).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    only = (q.Rule("symbols_per_word", None, 0.1),)
    assert {r.doc_id: r.kept for r in q.judge(make_docs(spark, texts), only).collect()}[0]


def test_filter_keeps_columns(spark, prose):
    plain = " ".join(f"word{k} the of" for k in range(60))
    df = make_docs(spark, [plain, "bad", None], extra=("kept", "bad"))
    out = q.keep_good(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [0]
    assert q.judge(df.limit(0)).collect() == []

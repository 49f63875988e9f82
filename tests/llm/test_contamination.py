import hashlib
import random
import re

from tests.llm.conftest import make_docs
from tidelog.llm import contamination as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        if i is None or t is None:
            continue
        w = WORD.findall(lower(t))
        parts = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []
        for p in parts:
            windows.setdefault(p, set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for size in {len(p) for p in windows}:
            for k in range(len(w) - size + 1):
                if (ids := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def fixture(seed, n_items=30):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([0, 1, 2, 5, 9, 10, 11, 14, 30])))) for k in range(n_items)]
    items += [(3, items[5][1]), (5, items[5][1]), (None, "w1 w2"), (99, None)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) > 2 or len(t.split()) == 0]
    docs = []
    for k in range(40):
        words = r.choices([*vocab, "z"], k=r.randint(0, 60))
        if k % 2:
            at = r.randint(0, len(words))
            words[at:at] = WORD.findall(r.choice(items)[1] or "")[r.randint(0, 3) :]
        docs.append((k, ", ".join(words).upper() if k % 3 else "-".join(words)))
    return [*docs, (100, None), (101, ""), (0, "repeated id w1"), (None, "w1 w2 w3 w4")], items


def test_report_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = fixture(seed)
        df = make_docs(spark, [t for _, t in docs], [i for i, _ in docs], extra=("spans", "items", "n_words"))
        it = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert rows(c.report(df, it)) == want
        small = c.find(c.texts(df), it, block_words=40).collect()  # many blocks
        assert sorted((str(r.doc_id), sum(s.end - s.start for s in r.spans), len(r["items"])) for r in small) == sorted((str(d), h, n) for d, _, h, n, _, _ in want)


def test_other_windows_and_case():
    docs, items = fixture(3)
    for window in (2, 3, 7):
        a = c.SuffixAutomaton([(str(i), c.words_of(t.encode())) for i, t in items if i is not None and t], window)
        got = []
        for d, t in docs:
            n, spans, found = c.match(a, (t or "").encode())
            ids = sorted({a.items[k] for k in found})
            got.append((d, n, sum(y - x for x, y in spans), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(spans)))
        assert sorted(got, key=str) == brute(docs, items, window)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = make_docs(spark, ["a b c", None])
    assert [(r.n_words, r.n_hit, r.contaminated) for r in c.report(df, none).orderBy("doc_id").collect()] == [(3, 0, False), (0, 0, False)]
    assert c.report(df.limit(0), none).collect() == []


def test_decontaminate(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    df = make_docs(spark, [f"Clean start, {item.upper()} clean end and more words after that to keep the share low, as it should be.", item, "clean", None, ""], extra=("spans",))
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in c.decontaminate(df, it).collect()}
    assert got == {0: "Clean start, clean end and more words after that to keep the share low, as it should be.", 2: "clean", 3: None, 4: ""}
    assert c.decontaminate(df, it).schema == df.schema
    assert {r.doc_id for r in c.decontaminate(df, it, max_span=20, max_coverage=1.0).where(f"text like '%ALPHA%'").collect()} == {0}

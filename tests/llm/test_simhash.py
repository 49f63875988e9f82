import random
import re

import pytest
import xxhash

from tests.llm.conftest import make_docs
from tidelog.llm import simhash
from tidelog.llm.components import components


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints_and_groups(spark, prose):
    fps = [brute_fingerprint(t) for t in prose]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(make_docs(spark, prose, extra=("fp", "component_id"))).collect()}
    assert {i: f for i, (f, _) in got.items()} == dict(enumerate(fps))
    assert {i: c for i, (_, c) in got.items()} == brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)


@pytest.mark.parametrize("cell", [1, 6, 1000])
def test_links_lose_nothing(spark, cell):
    r = random.Random(cell)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(6):  # chains and stars of near fingerprints
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps |= {0, 1, 3, 7, 2**63, 2**64 - 1}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {x.node: x.component for x in components(simhash.links(df, cell=cell)).collect()}
    signed = [simhash._signed(f) for f in fps]
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_pivots_find_and_discard(spark):
    """Cells hold every linked pair; the table discards most others, and no linked one, before any is verified."""
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(1500)}
    for f in list(fps)[:300]:
        for _ in range(3):
            g = f
            for _ in range(r.choice([1, 2, 2, 4, 6, 8])):
                g ^= 1 << r.randrange(64)
            fps.add(g)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = simhash.candidates(simhash.celled(df))
    rows = found.select("u", "v", simhash.discarded("du", "dv").alias("gone")).distinct().collect()
    apart = lambda x: ((x.u ^ x.v) % 2**64).bit_count()
    every = sorted(fps)
    linked = {(max(map(simhash._signed, p)), min(map(simhash._signed, p))) for k, x in enumerate(every) for p in ((x, y) for y in every[k + 1 :] if (x ^ y).bit_count() <= 2)}
    assert linked <= {(x.u, x.v) for x in rows} and not any(x.gone for x in rows if apart(x) <= 2)
    others = [x for x in rows if apart(x) > 2]
    assert len(linked) > 100 and len(others) > 50 and sum(x.gone for x in others) > 0.9 * sum(apart(x) > 4 for x in others) > 0


def test_components_of_awkward_graphs(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 30)]
    odd = [(200, 200), (None, 5), (7, None), (301, 300), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + odd, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_drop(spark):
    text = " ".join(f"word{k}" for k in range(300))
    df = make_docs(spark, [text, text, text + " x", "other text here", None, "", None], [5, 2, 9, 1, 7, 8, None], extra=("gone", "fp"))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "7", "None"]
    assert simhash.drop_near_duplicates(df.limit(0)).collect() == []


def test_drop_tells_rows_with_one_id_apart(spark):
    copy, mine = (" ".join(f"{w}{k}" for k in range(300)) for w in ("copy", "mine"))
    # 3 copies 1 and has a text of its own; 5 has two near texts; 8 is there three times
    rows = [(1, copy), (3, copy), (3, mine), (5, "one near text here"), (5, "one near text HERE"), (8, "thrice the same row"), (8, "thrice the same row"), (8, "thrice the same row")]
    kept = simhash.drop_near_duplicates(make_docs(spark, [t for _, t in rows], [i for i, _ in rows], extra=("doc", "hash", "n"))).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in kept) == sorted([(1, copy), (3, mine), (5, "one near text here"), (8, "thrice the same row")])

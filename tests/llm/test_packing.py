import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import make_docs
from tidelog.llm import packing


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(rows, want, capacity):
    """Every id in exactly one piece, and every sequence gapless within its capacity."""
    docs, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        ids = list(memoryview(bytes(r.ids)).cast("I"))
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        docs[r.doc_id][r.start] = ids
        assert r.doc_tokens == len(want[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        got = []
        for start in sorted(docs[d]):
            assert start == len(got)
            got += docs[d][start]
        assert got == ids
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


@pytest.mark.parametrize("capacity,windows,parts", [(4096, 32, 3), (64, 4, 5), (16, 1, 1)])
def test_round_trip(spark, prose, capacity, windows, parts):
    want = dict(enumerate(ids_of(prose)))
    df = make_docs(spark, prose, extra=("seq", "part", "length")).repartition(parts)
    rows = packing.pack(df, capacity=capacity, open_windows=windows, least_piece=1).collect()
    sequences = check(rows, want, capacity)
    total = sum(map(len, want.values()))
    assert len(sequences) == -(-total // capacity)  # no padding but in one sequence


def test_short_gaps_are_padded_instead_of_cut(spark, prose):
    rows = packing.pack(make_docs(spark, prose).repartition(2), capacity=128, open_windows=2, least_piece=8).collect()
    sequences = check(rows, dict(enumerate(ids_of(prose))), 128)
    filled = sorted(sum(n for _, n in s) for s in sequences.values())
    assert sum(f <= 120 for f in filled) <= 1


def test_memory_of_chunks_does_not_change_ids(prose):
    small = packing.ChunkTokenizer(remembered=3)
    texts = [*prose, "a~b ~ ~~ c", *(f"tok{k}" for k in range(200)), "It's 5. Then, O'Neil's... a,b .c E\u0301. <|EndOfText|> X", "<|endoftext|>. <|ENDOFTEXT|>, A", "I\u0307\u03a3. \u03a3a, \u00a0. b\u2003.\tc"]
    got = [x for t in texts for x in small.encode([(t or "").encode()])]
    assert [list(memoryview(g).cast("I")) for g in got] == [i[:-1] for i in ids_of(texts)]


def test_same_ids_and_empty(spark):
    rows = packing.pack(make_docs(spark, ["a b", "a b", None], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 1)]
    assert packing.pack(make_docs(spark, ["x"]).limit(0)).collect() == []
    assert {r.ids for r in packing.pack(make_docs(spark, ["a b"]), with_ids=False).collect()} == {None}


def test_another_vocabulary(spark, prose):
    """Chunks are remembered only where the vocabulary is known to part texts there."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 2] for k, x in enumerate(prose)}
    check(packing.pack(make_docs(spark, prose), tokenizer=path).collect(), want, packing.CAPACITY)


def test_plain_words_pass_by_the_normaliser(monkeypatch):
    """Unseen words of letters alone meet the merges directly; all ids are the tokenizer's, however texts are cut into pieces."""
    monkeypatch.setattr(packing, "PIECE", 40)
    coder = packing.ChunkTokenizer(remembered=30)

    class Seen:
        chunks = set()

        def encode_batch_fast(self, groups, **how):
            self.chunks.update(c for g in groups for c in g.split(" "))
            return tokenizer.encode_batch_fast(groups, **how)

    tokenizer, coder.tokenizer = coder.tokenizer, Seen()
    plain = "anblewh Sttible éaieux. Ùber STRASSE straße, œuvre ÿ y.\nEnd."
    texts = [plain, plain, "", " ", ".", "a., b", ", .a", "x.", "\n.\n,", "é K Å ǅ İ ÷ ª µ don't 12.5 a~b <|x", *(f"word{chr(97 + k % 26) * (k % 7)} tail{k}." for k in range(60)), " ".join(f"{plain} {k}" for k in range(20))]
    got = [x for at in range(0, len(texts), 7) for x in coder.encode([t.encode() for t in texts[at : at + 7]])]
    assert [list(memoryview(g).cast("I")) for g in got] == [i[:-1] for i in ids_of(texts)]
    assert "12.5" in Seen.chunks and not {"anblewh", "sttible", "éaieux", "strasse", "straße", "end"} & {c.lower() for c in Seen.chunks}

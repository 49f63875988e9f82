"""Exact removal of repeated passages, with windows partitioned into super-k-mers by minimiser."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, texts

WINDOW = 35
#: Words of a minimiser, and log2 of the cells in which minimisers are counted beforehand.
GRAM, CELL_BITS = 5, 27
#: Distinct packed strings of one minimiser that a task compares by itself, of SHARE windows each on average at most; the windows of more are counted by a shuffle.
CROWD, SHARE = 20_000, 32
#: Windows of a packed string: a longer run, as of one word over and over, goes in pieces.
LONGEST = 256

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


class Windows:
    """The super-k-mers of one text: runs of windows with the same minimiser, as long as they get up to LONGEST.

    The words are joined by single spaces in ``flat``; super-k-mer j has the windows that start at
    words first[j] to first[j] + count[j] - 1, minimiser mini[j], and twice[j] if that occurs in it
    more than once, so that even alone it may hold a window twice.
    """

    def __init__(self, text: bytes, window: int, gram: int):
        import xxhash

        words = text.split()
        self.window, self.n = window, len(words)
        self.first = self.count = np.zeros(0, np.int64)
        if self.n < window:
            return
        self.flat = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        g = h[: self.n - gram + 1] * _ODD[0]
        for k in range(1, gram):
            g = (g ^ (g >> np.uint64(29))) * _ODD[k % 8] + h[k : self.n - gram + 1 + k]
        g = (g ^ (g >> np.uint64(32))) * _ODD[5]
        g ^= g >> np.uint64(29)
        span = window - gram + 1  # minimiser places in a window
        least, size = g, 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(g) - span + 1], least[span - size :])
        self.first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        self.count = np.diff(np.append(self.first, len(least)))
        if (self.count > LONGEST).any():
            pieces = -(-self.count // LONGEST)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            self.first = np.repeat(self.first, pieces) + LONGEST * piece
            self.count = np.diff(np.append(self.first, len(least)))
        self.mini = least[self.first]
        places = np.arange(span)
        same_first = g[self.first[:, None] + places] == self.mini[:, None]
        last = self.first + self.count - 1
        same_last = g[last[:, None] + places] == self.mini[:, None]
        self.twice = (same_first.sum(1) > 1) | (same_last.sum(1) > 1) | (self.first + same_first.argmax(1) != last + same_last.argmax(1))

    def packed(self, j: int) -> bytes:
        a = self.first[j]
        return self.flat[self.starts[a] : self.ends[a + self.count[j] + self.window - 2]]


def _cells(mini: np.ndarray, bits: int) -> np.ndarray:
    return (mini & np.uint64((1 << bits) - 1)).astype(np.int64)


def _count_cells(window: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate([np.zeros(0, np.int64), *kept]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.minimum(n, 2).astype(np.int64))], names=["cell", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                w = Windows(t, window, gram)
                if len(w.first):
                    kept += [c := _cells(w.mini, bits), c[w.twice]]
                    size += len(c)
                    if size > 2_000_000:
                        yield flush()
                        kept, size = [], 0
        yield flush()

    return run


def repeated_cells(docs: DataFrame, window: int, gram: int, bits: int) -> np.ndarray:
    """A bitmap of 2**bits cells: those that hold more than one place of a minimiser over all texts.

    Its size is fixed. It only saves the shuffle of what can't repeat: a set bit decides nothing.
    """
    counts = texts(docs).select("text").mapInArrow(_count_cells(window, gram, bits), "cell long, n long")
    words = (
        counts.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
        .groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
    )
    got = words.toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bitmap


_PACKED = pa.schema([("mini", pa.int64()), ("body", pa.binary()), ("n", pa.int32()), ("docs", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])


def _pack(shared, window: int, gram: int, bits: int):
    """Super-k-mers that may repeat, one row for each string of a task with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        held: dict[tuple[int, bytes], tuple[int, list, list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(m, b, *v) for (m, b), v in held.items()]
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 5000]), _PACKED)], schema=_PACKED)

        for batch in batches:
            for d, t, h in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                w = Windows(t, window, gram)
                if not len(w.first):
                    continue
                cell = _cells(w.mini, bits)
                mini = w.mini.view(np.int64)
                for j in np.flatnonzero((bitmap[cell >> 6] >> (cell & 63)) & 1).tolist():
                    key = (int(mini[j]), w.packed(j))
                    if (old := held.get(key)) is None:
                        held[key] = old = (int(w.count[j]), [], [], [])
                        size += len(key[1]) + 300
                    old[1].append(d)
                    old[2].append(h)
                    old[3].append(int(w.first[j]))
                    size += 24
                if size > 64 << 20:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    return run


def _slices(body: bytes, window: int) -> list[bytes]:
    """The windows of a packed string."""
    ends = [i for i, c in enumerate(body) if c == 32] + [len(body)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [body[a:b] for a, b in zip(starts, ends[window - 1 :])]


def compare(bodies: list[tuple[bytes, bool]], window: int) -> list[list[bool]]:
    """For each of distinct strings (and whether it occurs more than once), which of its windows occur more than once.

    The windows are sorted, so equal ones stand together.
    """
    windows = [_slices(b, window) for b, _ in bodies]
    marks = [[many] * len(w) for w, (_, many) in zip(windows, bodies)]
    order = sorted((x, j, k) for j, w in enumerate(windows) for k, x in enumerate(w))
    for (x, j, k), (y, i, l) in zip(order, order[1:]):
        if x == y:
            marks[j][k] = marks[i][l] = True
    return marks


_FOUND = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("window", pa.binary())])


def _resolve(window: int, crowd: int):
    """Rows sorted by minimiser and string: places (start, n windows) that repeat, or single windows yet to be counted.

    A string with several places is settled as it streams by; what is held for a minimiser are
    distinct strings, crowd at most, and of SHARE * crowd windows. If there are more, all their windows go on by digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def alone(held, crowded: bool):
            """What strings with a single place, and the windows of the others, have to say."""
            if crowded:
                for body, place in held:
                    for k, x in enumerate(_slices(body, window)):
                        digest = hashlib.blake2b(x, digest_size=16).digest()
                        if place:
                            out.append((place[0], place[1], place[2] + k, 1, digest))
                        else:  # twice: whatever equals it repeats
                            out.extend(((None, None, None, None, digest),) * 2)
            else:
                for marks, (_, place) in zip(compare([(b, p is None) for b, p in held], window), held):
                    if place:
                        at = 0
                        for m, run_ in groupby(marks):
                            size = len(list(run_))
                            if m:
                                out.append((place[0], place[1], place[2] + at, size, None))
                            at += size

        def flush(all_: bool) -> Iterator[pa.RecordBatch]:
            while len(out) >= 20_000 or all_ and out:
                some = out[:20_000]
                del out[:20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _FOUND)], schema=_FOUND)

        for _, same_mini in groupby(rows(), key=lambda r: r[0]):
            held, crowded, size = [], False, 0
            for body, same in groupby(same_mini, key=lambda r: r[1]):
                first, several = None, False
                n = 0
                for _, _, n, docs, hashes, starts in same:
                    places = list(zip(docs, hashes, starts))
                    if first is None and len(places) == 1:
                        first = (*places[0], n)
                        continue
                    several = True
                    if first and first[3]:
                        out.append((*first, None))
                        first = (None, None, None, 0)
                    first = first or (None, None, None, 0)
                    out.extend((*p, n, None) for p in places)
                    yield from flush(False)
                held.append((body, None if several else first[:3]))
                size += n
                crowded = crowded or len(held) > crowd or size > SHARE * crowd
                if crowded:
                    alone(held, True)
                    held = []
                    yield from flush(False)
            if held and (crowded or len(held) > 1 or held[0][1]):
                alone(held, crowded)
            yield from flush(False)
        yield from flush(True)

    return run


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cell_bits: int = CELL_BITS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, spans): the word spans of each document that windows found more than once cover.

    th is the text's hash; equal rows share one result. Each super-k-mer travels once, as one
    string, to the bucket of its minimiser, where sorting its windows counts them exactly.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, window, gram, cell_bits))
    rows = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("th"))
    packed = rows.mapInArrow(_pack(bitmap, window, gram, cell_bits), "mini long, body binary, n int, docs array<long>, hashes array<long>, starts array<int>")
    found = packed.repartition("mini").sortWithinPartitions("mini", "body").mapInArrow(_resolve(window, crowd), "doc_id long, th long, start long, n long, window binary")
    found = cut(found)
    open_ = found.where("window is not null")
    counted = open_.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
    more = open_.where("start is not null").join(counted, "window", "left_semi")
    places = found.where("window is null").unionByName(more).select("doc_id", "th", F.struct("start", (F.col("start") + F.col("n") + (window - 1)).alias("end")).alias("s"))
    return places.groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans"))


def keep_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words outside the spans, and the number of all words."""
    words = text.split()
    if not spans:
        return words, len(words)
    keep = np.ones(len(words), bool)
    for a, b in spans:
        keep[a:b] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()], len(words)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept = [], [], []
        for t, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            words, all_ = keep_words(t, [(s["start"], s["end"]) for s in spans or ()])
            n.append(all_)
            removed.append(all_ - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    A word goes if a window of ``window`` words covers it whose words also start anywhere else, in
    the same text or another; windows are judged on the input. All occurrences go, the first
    included. Null or empty text has no words; rows with the same doc_id are judged one by one;
    extra columns are ignored; an empty table has no rows.
    """
    rows = texts(docs).withColumn("th", F.xxhash64("text"))
    spans = repeated(docs, window, **how).withColumnsRenamed({"doc_id": "d", "th": "h"})
    joined = rows.join(spans, rows.doc_id.eqNullSafe(spans.d) & (rows.th == spans.h), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")

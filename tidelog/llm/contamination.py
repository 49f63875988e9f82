"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.session import ship_package
from tidelog.llm.common import cut, lean, spare, texts

WINDOW = 10
#: Words of test items that one automaton may hold; more items are matched in further passes over the documents.
BLOCK_WORDS = 200_000
#: Bytes that a word may have before its digest takes its place.
LONG = 256

_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of digits, letters and whatever isn't ASCII, with A-Z lower-cased.

    A word of more than LONG bytes is stood for by its digest, so that a number of words bounds their bytes too.
    """
    words = text.lower().translate(_WORD_BYTES).split()
    if len(text) > LONG and max(map(len, words), default=0) > LONG:
        words = [w if len(w) <= LONG else b" " + hashlib.sha256(w).digest() for w in words]
    return words


class SuffixAutomaton:
    """Generalised suffix automaton over the words of many items.

    ``scan`` streams a document's words and yields, for every position at which the longest
    match with the items ends and contains a whole window, the start of that window and the
    items that hold it. An item shorter than a window is a window by itself.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.items = window, [i for i, _ in items]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: For each state the items whose short window ends there, and (after _spread) those of its substrings.
        short: dict[int, set[int]] = {}
        ends: dict[int, set[int]] = {}
        for k, (_, words) in enumerate(items):
            at = 0
            for j, w in enumerate(words):
                at = self._extend(at, w)
                ends.setdefault(at, set()).add(k)
            if words and len(words) < window:
                short.setdefault(at, set()).add(k)
        self._spread(ends, short, items)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _spread(self, ends, short, items) -> None:
        """Walk the suffix links, longest state first, for what ends in each state.

        hold[s]: items that contain the state's strings, kept only where a string is as long as a
        window. tail[s]: whole short items that are suffixes of the state's strings, longest first.
        """
        link, length, n = self.link, self.length, len(self.link)
        order = sorted(range(n), key=length.__getitem__)
        for s in reversed(order):
            if link[s] > 0 and length[link[s]] >= self.window and s in ends:
                ends.setdefault(link[s], set()).update(ends[s])
        #: The ancestor whose strings include the last window words, if the state is as deep as that.
        top = [0] * n
        self.tail: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * n
        for s in order[1:]:
            if length[s] >= self.window:
                top[s] = top[link[s]] if length[link[s]] >= self.window else s
            above = self.tail[link[s]]
            self.tail[s] = ((length[s], frozenset(short[s])), *above) if s in short else above
        held: dict[int, frozenset[int]] = {}
        self.hold: list[frozenset[int] | None] = [None] * n
        for s in order[1:]:
            if length[s] >= self.window:
                if top[s] not in held:
                    held[top[s]] = frozenset(ends.get(top[s], ()))
                self.hold[s] = held[top[s]]
        #: Shortest match at which anything can be reported.
        self.least = min([self.window, *(t[0] for s in short for t in self.tail[s])])

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(start, end, items) of each window that occurs; starts and ends don't decrease for full windows."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        at = long = 0
        root = nxt[0]
        here = root
        for i, w in enumerate(words):
            to = here.get(w)
            if to is None:
                if not at:
                    continue
                while at and to is None:
                    at = link[at]
                    to = nxt[at].get(w)
                long = length[at]
                if to is None:
                    at = long = 0
                    here = root
                    continue
            at = to
            here = nxt[to]
            long += 1
            if long >= least:
                # the state may stand for longer strings than what matched: go by the matched length
                if long >= window:
                    s = at
                    yield i + 1 - window, i + 1, self.hold[s] or frozenset()
                for size, which in self.tail[at]:
                    if size <= long:
                        yield i + 1 - size, i + 1, which


def match(automaton: SuffixAutomaton, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit spans of word positions (merged, ascending), indexes of the items found."""
    words = words_of(text)
    found: set[int] = set()
    hits: list[tuple[int, int]] = []
    for start, end, which in automaton.scan(words):
        found |= which
        hits.append((start, end))
    return len(words), merge(hits), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, streamed to the driver in blocks of bounded size, at least one.

    Those without id or words are left out.
    """
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        words = words_of(r.t.encode())
        # a very long item is cut into parts that overlap by a window, so no window is lost
        for at in range(0, max(1, len(words) - window + 1) if words else 0, block_words):
            part = words[at : at + block_words + window - 1]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((r.i, part))
            size += len(part)
    yield block


_AUTOMATA: dict[int, SuffixAutomaton] = {}
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared, window: int, text: str, spans: str, items: str, count: str, drop_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.value[0]
        if key not in _AUTOMATA:  # one for each worker and block
            _AUTOMATA.clear()
            _AUTOMATA[key] = SuffixAutomaton(shared.value[1], window)
        automaton = _AUTOMATA[key]
        for batch in batches:
            names = batch.schema.names
            new_spans, new_items, counts = [], [], []
            for t, old, ids in zip(batch.column(names.index(text)).cast(pa.binary()).to_pylist(), batch.column(names.index(spans)).to_pylist(), batch.column(names.index(items)).to_pylist()):
                n, hits, found = match(automaton, t or b"")
                if old:
                    hits = merge([(s["start"], s["end"]) for s in old] + hits)
                counts.append(n)
                new_spans.append([{"start": a, "end": b} for a, b in hits])
                new_items.append(sorted({*(ids or ()), *(automaton.items[k] for k in found)}))
            new = {spans: pa.array(new_spans, _SPAN), items: pa.array(new_items, pa.list_(pa.string())), count: pa.array(counts, pa.int64())}
            kept = [n for n in names if not (drop_text and n == text)]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(names.index(n))) for n in kept], names=kept)

    return run


def find(docs: DataFrame, items: DataFrame, *, text: str = "text", spans: str = "spans", found: str = "items", count: str = "n_words",
         window: int = WINDOW, block_words: int = BLOCK_WORDS, drop_text: bool = False) -> DataFrame:
    """docs with spans (merged word positions hit, end exclusive), found (item ids, as sorted strings) and count (words).

    All columns of docs stay, without the text if drop_text. A document's word is hit if any
    occurrence of a window of an item covers it. The items are broadcast in blocks of at most
    block_words words, each block with a pass over the documents, which are never shuffled.
    Null text has no words; items with a null id or text are none; repeated items count once by
    id; without items nothing is hit.
    """
    ship_package(docs.sparkSession)
    out = docs.withColumns({
        spans: F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), found: F.lit(None).cast("array<string>"),
        count: F.lit(None).cast("bigint"),
    })
    sc, waiting, passes = docs.sparkSession.sparkContext, None, 0
    for block in _then_none(blocks(items, window, block_words)):
        if waiting is not None:
            last = block is None
            if passes:
                out = cut(out)  # one automaton at a time in a task
            seed = int.from_bytes(hashlib.sha256(repr(waiting).encode()).digest()[:8], "big") ^ window
            drop = drop_text and last
            run = _scan(sc.broadcast((seed, waiting)), window, text, spans, found, count, drop)
            out = out.mapInArrow(lean(run, "contamination"), out.drop(text).schema if drop else out.schema)
            passes += 1
        waiting = block
    return out


def _then_none(it):
    yield from it
    yield None


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated, spans.

    Null and empty text have no words and no hits; rows are judged one by one, repeated ids and null
    ids included; other columns are ignored. Without items, or without rows, nothing is hit.
    """
    none = F.lit(0).cast("bigint")
    return find(texts(docs), items, window=window, drop_text=True).select(
        "doc_id", "n_words", F.aggregate("spans", none, lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans",
    )


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the words of the spans and what stands between them; a space doubled by that goes too."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    out, last = [], 0
    for start, end in spans:
        a, b = at[start][0], at[end - 1][1]
        piece = text[last:a]
        if piece.endswith(b" ") and text[b : b + 1] == b" ":
            piece = piece[:-1]
        out.append(piece)
        last = b
    return b"".join([*out, text[last:]])


def _remove(text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            old = batch.column(names.index(text))
            new = [without(t, [(s["start"], s["end"]) for s in h]).decode() if h else t and t.decode() for t, h in zip(old.cast(pa.binary()).to_pylist(), batch.column(names.index(spans)).to_pylist())]
            kept = [n for n in names if n != spans]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else batch.column(names.index(n)) for n in kept], names=kept)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.8) -> DataFrame:
    """docs, same columns, with test items removed from the text.

    Hit spans of more than max_span words are cut out; a document of whose words more than
    max_coverage are hit goes as a whole. Everything else, nulls included, stays as it is.
    """
    spans, found = spare(docs.columns, "spans"), spare(docs.columns, "items")
    count = spare(docs.columns, "n_words")
    rows = find(docs, items, spans=spans, found=found, count=count, window=window)
    size = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    rows = rows.where(size <= F.col(count) * max_coverage).drop(found, count)
    if max_span:
        rows = rows.withColumn(spans, F.filter(spans, lambda s: s["end"] - s["start"] > max_span))
    return rows.mapInArrow(lean(_remove("text", spans), "contamination"), docs.schema)

"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut, kept, lean, texts

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
_PIECES = "doc_id long, start long, length long, doc_tokens long, part long, seq long, offset long, is_open boolean, ids binary, ids_crc32 long"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "part", "seq", "offset", "is_open", "ids", "ids_crc32"]
_TYPES = pa.schema([*((n, pa.int64()) for n in _NAMES[:7]), ("is_open", pa.bool_()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
_LEFTOVERS = 1 << 62


#: A full stop or comma between one of these bytes and white space, or the end, is a token of its own.
_WORDY = np.zeros(256, bool)
_WORDY[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: Chunks of nothing but such letters (lower-cased) need no normalising, and are one word of the vocabulary's.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes of text that are encoded together at most, if a text has a space that early.
PIECE = 1 << 22


class Chunks:
    """Chunks of text and their ids, which lie end to end: ``slots`` numbers the chunks, ``starts`` says where each begins."""

    def __init__(self):
        self.slots, self.ids, self.starts = {b"": 0}, array("I"), array("Q", [0, 0])

    def add(self, chunks: list[bytes], ids: bytes, ends) -> None:
        """Chunks whose ids, laid end to end, end at ``ends``."""
        first, base = len(self.starts) - 1, len(self.ids)
        self.slots.update(zip(chunks, range(first, first + len(chunks))))
        self.ids.frombytes(ids)
        self.starts.extend([base + e for e in ends])

    def of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks of these numbers, laid end to end, and where each ends, from 0 on."""
        starts = np.frombuffer(self.starts, np.uint64).astype(np.int64)
        first, n = starts[chunks], starts[chunks + 1] - starts[chunks]
        ends = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat(first - ends[:-1], n)
        places += np.arange(len(places))
        ids = np.frombuffer(self.ids, np.uint32)
        return ids.take(places) if len(places) else ids[:0], ends


class ChunkTokenizer:
    """Ids of whole UTF-8 texts as little-endian uint32 bytes.

    The vocabulary's normaliser lower-cases and turns white space into breaks that no merge
    crosses. So a text, its A-Z lower-cased (unless it may name a special token), is cut at
    spaces, newlines and before a word's full stop or comma, and the ids of each chunk are
    remembered. The memory is bounded: two generations of ``remembered`` chunks, of which the
    older is dropped. Texts are encoded whole with any other vocabulary.
    """

    def __init__(self, path: str | None = None, remembered: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer, self.whole = Tokenizer.from_file(path), os.path.basename(path) != VOCABULARY
        if self.whole:
            return
        (self.tilde,) = self.tokenizer.encode("~", add_special_tokens=False).ids
        # the same merges without the normaliser and its patterns
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.remembered, self.young, self.old = remembered, Chunks(), Chunks()

    def encode(self, batch: list[bytes]) -> list[bytes]:
        if self.whole:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in batch], add_special_tokens=False)]
        out: list[bytes] = []
        held, size = [], 0
        for t in batch:
            t = t if b"<|" in t else t.lower()
            if size + len(t) > PIECE:
                out += self._encode(held)
                held, size = [], 0
            if len(t) > PIECE:
                out.append(b"".join(x for p in _pieces(t) for x in self._encode([p])))
            else:
                held.append(t)
                size += len(t)
        return out + self._encode(held)

    def _encode(self, batch: list[bytes]) -> list[bytes]:
        if not batch:
            return []
        data = np.frombuffer(b"\n".join([*batch, b""]), np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in batch)])
        stops = np.flatnonzero((data == ord(".")) | (data == ord(",")))
        after = data[stops + 1]
        stops = stops[_WORDY[data[stops - 1]] & ((after == ord(" ")) | (after == ord("\n")))]
        data = np.insert(data, stops, ord(" "))
        data[data == ord("\n")] = ord(" ")
        bounds += np.searchsorted(stops, bounds)
        split = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        split = pc.split_pattern(split, b" ")
        chunks = split.values.dictionary_encode()
        distinct, which = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        if len(self.young.slots) > self.remembered:
            self.young, self.old = Chunks(), self.young
        young = self.young
        slots = list(map(young.slots.get, distinct))
        if None in slots:
            self._learn([c for c, k in zip(distinct, slots) if k is None])
            slots = list(map(young.slots.__getitem__, distinct))
        ids, ends = young.of(np.array(slots)[which])
        flat, ends = ids.tobytes(), (4 * ends[split.offsets.to_numpy()]).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of chunks that the young generation lacks."""
        plain, words, marked, alone, again, slots = [], [], [], [], [], []
        for c, w in zip(chunks, b" ".join(chunks).decode().lower().split(" ")):
            if (k := self.old.slots.get(c)) is not None:
                again.append(c)
                slots.append(k)
            elif _PLAIN.fullmatch(w):
                plain.append(c)
                words.append(w)
            else:
                (alone if b"~" in c else marked).append(c)
        ids, ends = self.old.of(np.array(slots, int))
        self.young.add(again, ids.tobytes(), ends[1:].tolist())
        groups = [words[at : at + 64] for at in range(0, len(words), 64)]
        for k, e in enumerate(self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            self.young.add(plain[64 * k : 64 * k + 64], ids.tobytes(), (np.flatnonzero(self.last[ids]) + 1).tolist())
        self._mark(marked, 64)
        self._mark(alone, 1)

    def _mark(self, chunks: list[bytes], together: int) -> None:
        """Encode unseen chunks, several to a call: a tilde between them is always one token, which no chunk holds."""
        groups = [chunks[at : at + together] for at in range(0, len(chunks), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ~ ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            if len(group) == 1:
                self.young.add(group, ids.tobytes(), [len(ids)])
                continue
            between = ids == self.tilde
            at = np.flatnonzero(between)
            self.young.add(group, ids[~between].tobytes(), [*(at - np.arange(len(at))).tolist(), len(ids) - len(at)])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are looked at together: 1024, or fewer of some PIECE bytes of text."""
    sizes, at = np.cumsum(pc.binary_length(batch.column(1).cast(pa.binary())).to_numpy()), 0
    while at < len(sizes):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right"))
        end = min(max(end, at + 1), at + 1024)
        yield batch.slice(at, end - at)
        at = end


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces into pieces of about PIECE bytes."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def tokenizer_at(path: str | None) -> ChunkTokenizer:
    """One tokenizer for each Python worker, kept over its tasks."""
    tokenizers = kept("packing")
    if path not in tokenizers:
        tokenizers[path] = ChunkTokenizer(path)
    return tokenizers[path]


class WindowPacker:
    """Best-fit packing with a fixed number of open windows.

    ``add`` returns the windows that it closed, ``leftovers`` those still open;
    a window is a list of (doc, start, length, doc_tokens, ids).  A document of
    a window or more is cut into full windows; the rest goes to the open window
    that it fills best.  When none fits and no further window may be opened, the
    fullest is emitted, after the document's next ids have filled it up, unless
    fewer than ``least_piece`` places are free.
    """

    def __init__(self, capacity: int = CAPACITY, open_windows: int = 32, least_piece: int = 8):
        self.capacity, self.most, self.least_piece = capacity, open_windows, least_piece
        self.windows: list[list] = []  # [filled, pieces]

    def add(self, doc, ids: bytes) -> list[list[tuple]]:
        n, at, closed, cap = len(ids) // 4, 0, [], self.capacity

        def piece(length: int) -> tuple:
            return (doc, at, length, n, ids[4 * at : 4 * (at + length)])

        while n - at >= cap:
            closed.append([piece(cap)])
            at += cap
        while at < n:
            rest = n - at
            fits = [w for w in self.windows if cap - w[0] >= rest]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[1].append(piece(rest))
                best[0] += rest
                if best[0] == cap:
                    self._close(best, closed)
                break
            if len(self.windows) < self.most:
                self.windows.append([rest, [piece(rest)]])
                break
            fullest = max(self.windows, key=lambda w: w[0])
            free = cap - fullest[0]
            if free >= self.least_piece:
                fullest[1].append(piece(free))
                at += free
            self._close(fullest, closed)
        return closed

    def _close(self, window: list, closed: list) -> None:
        self.windows = [w for w in self.windows if w is not window]
        closed.append(window[1])

    def leftovers(self) -> list[list[tuple]]:
        left, self.windows = [w[1] for w in self.windows], []
        return left


def _pack_partition(path, capacity, open_windows, least_piece, end_id, with_ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, end = TaskContext.get().partitionId(), 0, array("I", [end_id]).tobytes()
        coder, packer = tokenizer_at(path), WindowPacker(capacity, open_windows, least_piece)

        def out(windows, is_open: bool, first: int) -> pa.RecordBatch:
            rows, offset = [], 0
            for k, window in enumerate(windows):
                offset = offset if is_open else 0
                for doc, start, length, n, ids in window:
                    rows.append((doc, start, length, n, part, first + k, offset, is_open, ids if with_ids or is_open else None, zlib.crc32(ids)))
                    offset += length
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t.type) for t in _TYPES], schema=_TYPES)

        for batch in batches:
            for some in _slices(batch):
                closed = []
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1).cast(pa.binary()).to_pylist())):
                    closed += packer.add(doc, ids + end)
                if closed:
                    yield out(closed, False, seq)
                    seq += len(closed)
        yield out(packer.leftovers(), True, seq)

    return run


def pack(
    docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, open_windows: int = 32,
    least_piece: int = 8, end_id: int = 2, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``capacity`` ids.

    Returns doc_id, start, length, ids (binary, little-endian uint32; null unless with_ids),
    ids_crc32, doc_tokens, sequence_id, offset.  Each partition packs its own documents with
    ``open_windows`` windows; the windows left open at its end, at most that many, are then laid
    end to end over all partitions and cut anew into full windows, so that one sequence at most
    stays short.  Only they carry their ids through a shuffle.

    A null or empty text is the end id alone.  Rows with the same doc_id, or none, are packed as
    documents of their own.  An empty table has no pieces.  Other columns are ignored.
    """
    run = _pack_partition(tokenizer, capacity, open_windows, least_piece, end_id, with_ids)
    pieces = cut(texts(docs).mapInArrow(lean(run, "packing"), _PIECES))
    keep = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    done = pieces.where("not is_open").withColumn("sequence_id", F.shiftleft("part", 33) + F.col("seq")).select(keep)
    left = pieces.where("is_open")
    # one row a partition: where its leftovers begin
    base = left.groupBy("part").agg(F.sum("length").alias("t"))
    base = base.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    at, cap = F.col("at"), F.lit(capacity).cast("bigint")
    low, high = F.greatest(at, F.col("k") * cap), F.least(at + F.col("length"), (F.col("k") + 1) * cap)
    merged = (
        left.join(base, "part").withColumn("at", F.col("base") + F.col("offset"))
        .withColumn("k", F.explode(F.sequence(F.floor(at / cap), F.floor((at + F.col("length") - 1) / cap))))
        .select("doc_id", (F.col("start") + low - at).alias("start"), (high - low).alias("length"),
                F.expr(f"substring(ids, cast(4 * (greatest(at, k * {capacity}) - at) + 1 as int), cast(4 * (least(at + length, (k + 1) * {capacity}) - greatest(at, k * {capacity})) as int))").alias("ids"),
                "doc_tokens", (F.lit(_LEFTOVERS) + F.col("k")).alias("sequence_id"), (low - F.col("k") * cap).alias("offset"))
        .withColumn("ids_crc32", F.crc32("ids"))
    )
    if not with_ids:
        merged = merged.withColumn("ids", F.lit(None).cast("binary"))
    return done.unionByName(merged.select(keep))

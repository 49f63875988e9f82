"""Hashed maximum-entropy language model with a class-factored softmax, and its add-one unigram base.

p(w | h) = p(class of w | h) * (c(w) + 1) / R(class of w).  The commonest tokens are classes of
their own; every other word's class is a hash of its ending. The class is predicted by a softmax
over hashed features of the history: the token before (n-gram) and the one before that (skip).

With hashed=True both factors depend on the real words before: a class's words fall into INNER
groups by their hash, and p(w | h) = p(class | h) * p(group | class, h) * (c(w) + 1) / R(class, group).
Both softmaxes are factored along binary trees. Hashes of the word before (n-gram) and, for the class,
of the one before that (skip) choose weights, in a table of 2^WEIGHT_BITS, that move the odds at each node.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, kept, lean, texts

#: Classes: SINGLE common tokens, then ENDINGS hash values (a power of two). One more history stands for the text's start.
SINGLE, ENDINGS = 64, 64
CLASSES, HISTORIES = SINGLE + ENDINGS, SINGLE + ENDINGS + 1
START = CLASSES
#: Words whose counts are broadcast; the counts of all others are joined.
COMMON = 200_000
#: Words that a lexicon numbers besides before it forgets them; passes over texts only look up.
REMEMBERED = 250_000
END = b""  # no word is empty
#: Weights over hashes of real words, half of them for classes; groups in a class (a power of two); features of a class's history.
WEIGHT_BITS, INNER, FEATURES = 21, 64, 2
#: Passes over the training texts for them; turns that are added to what is seen and expected of each weight.
PASSES, PRIOR = 1, 4.0
#: Tokens looked at together at most (a text of more goes in pieces).
PIECE = 8_000
#: Texts looked up together at most, and bytes of them unless one text has more.
TEXTS, BYTES = 1000, 1 << 22
#: Weights travel in blocks of this many.
BLOCK = 4096


def tokens(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased, then the end."""
    return [*text.lower().split(), END]


_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def laid(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of texts, which of them each token is, texts laid end to end, and where the texts begin."""
    data = b" ".join([*texts, b""]).lower().translate(_SPACES)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    split = pc.split_pattern(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]), b" ")
    chunks = split.values.dictionary_encode()
    distinct, which, bounds = chunks.dictionary.to_pylist(), chunks.indices.to_numpy(), split.offsets.to_numpy()
    # the last chunk of a text is empty, and stands for its end; no other empty one is a token
    stays = which != distinct.index(END)
    stays[bounds[1:] - 1] = True
    before = np.concatenate(([0], np.cumsum(stays)))
    return distinct, which[stays], before[bounds[:-1]]


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    column = column.cast(pa.binary())
    sizes, at = np.cumsum(pc.binary_length(column).to_numpy()), 0
    while at < len(sizes):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES, "right"))
        end = min(max(end, at + 1), at + TEXTS)
        yield column.slice(at, end - at).to_pylist()
        at = end


def held_out(folds: int = 7, fold: int = 2):
    """True for rows not learned from: crc32 of the id's text modulo folds; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def _ending(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word[-3:], 42) & (ENDINGS - 1)


def _code(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for t in batch.column(0).cast(pa.binary()).to_pylist():
            counts.update(tokens(t))
            if len(counts) > 300_000:
                yield flush()
                counts.clear()
    yield flush()


def count_tokens(training: DataFrame) -> DataFrame:
    """(word binary, c): every token of the training texts."""
    return training.select("text").mapInArrow(lean(_count, "language_model"), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon(dict):
    """Common token to number, and ``further`` ones for a while; ``kind``, ``code`` and ``log`` hold the class, the hash and log10(c + 1) of each number (nan: to be joined)."""

    def __init__(self, common: list[tuple[bytes, int]], single: list[bytes]):
        super().__init__()
        self.single = {w: k for k, w in enumerate(single)}
        self.words: list[bytes] = []
        self.kind, self.code, self.log = array("i"), array("Q"), array("d")
        self.endings: dict[bytes, int] = {}
        known = {w for w, _ in common}
        other = [w for w in single if w not in known]
        self._add(self, [w for w, _ in common] + other, np.append(np.log10(np.array([c for _, c in common], float) + 1), np.full(len(other), np.nan)))
        for w, k in self.single.items():
            self.kind[self[w]] = k
        self.base, self.further = len(self.words), {}

    def _kinds(self, words: list[bytes]) -> list[int]:
        """The ending classes of words."""
        ends = [w[-3:] for w in words]
        kinds = list(map(self.endings.get, ends))
        if None in kinds:
            if len(self.endings) > 100_000:
                self.endings.clear()
            self.endings.update((e, SINGLE + _ending(e)) for e in set(ends))
            kinds = list(map(self.endings.__getitem__, ends))
        return kinds

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, codes and logs (nan: to be joined) of words; what isn't common is worked out each time, which takes less than remembering it."""
        import xxhash

        found = np.array(list(map(self.get, words, repeat(-1))), np.int64)
        kinds, codes, logs = self.classes(found), self.codes(found), self.logs(found)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            new = [words[i] for i in rest.tolist()]
            kinds[rest] = self._kinds(new)
            codes[rest] = np.fromiter(map(xxhash.xxh64_intdigest, new, repeat(42)), np.uint64, len(new))
            logs[rest] = np.nan
        return kinds, codes, logs

    def _add(self, to: dict, words: list[bytes], logs: np.ndarray) -> None:
        import xxhash

        n = len(self.words)
        to.update(zip(words, range(n, n + len(words))))
        self.words += words
        self.kind.extend(self._kinds(words))
        self.code.extend(map(xxhash.xxh64_intdigest, words, repeat(42)))
        self.log.frombytes(logs.tobytes())

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > self.base + REMEMBERED:
            self.further.clear()
            del self.words[self.base :], self.kind[self.base :], self.code[self.base :], self.log[self.base :]
        found = np.array(list(map(self.get, words, repeat(-1))), np.int64)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            words = [words[i] for i in rest.tolist()]
            new = list(dict.fromkeys(w for w in words if w not in self.further))
            self._add(self.further, new, np.full(len(new), np.nan))
            found[rest] = list(map(self.further.__getitem__, words))
        return found

    def classes(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.kind, np.int32)[numbers].astype(np.int64)

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.code, np.uint64)[numbers]

    def logs(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.log, np.float64)[numbers]


def _lexicon(shared) -> Lexicon:
    """One lexicon for each Python worker, kept over its tasks."""
    key, common, single = shared.value
    lexica = kept("language_model")
    if key not in lexica:
        lexica.clear()
        lexica[key] = Lexicon(common, single)
    return lexica[key]


_ONE_TEXT = np.zeros(1, np.int64)


def _before(x: np.ndarray, first, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands one and two places before, ``first`` where a text that begins at ``starts`` has no such place."""
    one, two = np.empty_like(x), np.empty_like(x)
    one[1:] = x[:-1]
    one[starts] = first
    two[1:] = one[:-1]
    two[starts] = first
    return one, two


def histories(classes: np.ndarray, starts: np.ndarray = _ONE_TEXT) -> np.ndarray:
    """The number of the history of each token of texts laid end to end: its two features, the class before and the one before that."""
    one, two = _before(classes, START, starts)
    return one * HISTORIES + two


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def features(codes: np.ndarray, starts: np.ndarray = _ONE_TEXT) -> np.ndarray:
    """FEATURES hashes of the history of each token of texts laid end to end: the word before, the one before that."""
    one, two = _before(codes, 1, starts)
    return np.stack((_mixed(one, 1), _mixed(two, 2)))


def groups(codes: np.ndarray) -> np.ndarray:
    """The group of each word in its class."""
    return ((codes >> np.uint64(32)) & np.uint64(INNER - 1)).astype(np.int64)


def odds(p: np.ndarray) -> np.ndarray:
    """For rows of probabilities, the log odds of the right side at each node of a binary tree over them (node 1 is the root)."""
    n = p.shape[1]
    mass = np.concatenate([np.zeros_like(p), p], axis=1)
    for node in range(n - 1, 0, -1):
        mass[:, node] = mass[:, 2 * node] + mass[:, 2 * node + 1]
    out = np.zeros(p.shape)
    out[:, 1:] = np.log(mass[:, 3::2]) - np.log(mass[:, 2::2])
    return out.astype(np.float32)


def _path(leaf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes from the root to each leaf of a tree over n, and whether it turns right there."""
    down = np.arange(n.bit_length() - 1, 0, -1)
    return (n + leaf[:, None]) >> down, ((leaf[:, None] >> (down - 1)) & 1).astype(bool)


#: Names of nodes: those over the classes, then those over the groups of each class.
_NODES = np.arange((1 + CLASSES) * CLASSES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Paths to all classes and to all groups of a class, a column each; and for those of each ending class the names of the nodes.
_TO_CLASS, _CLASS_TURNS = (np.ascontiguousarray(x.T) for x in _path(np.arange(CLASSES), CLASSES))
_TO_GROUP, _GROUP_TURNS = (np.ascontiguousarray(x.T) for x in _path(np.arange(INNER), INNER))
_TO_CLASS_NAMED = _NODES[_TO_CLASS]
_TO_GROUP_NAMED = _NODES[_TO_GROUP[:, None] + (1 + np.arange(SINGLE, CLASSES))[:, None] * CLASSES].reshape(len(_TO_GROUP), -1)


def _places(x: np.ndarray) -> np.ndarray:
    """Places in half the table."""
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x >>= np.uint64(65 - WEIGHT_BITS)
    return x.view(np.int64).ravel()


@dataclass(frozen=True)
class Hashed:
    """Both factors as products of two-way softmaxes along trees; a node's logit is its base and a weight of each feature.

    The weight of a feature at a node is found by the hash of both in a table of 2^WEIGHT_BITS.
    Without weights, classes have the odds of the class model, and groups those of their counts.
    """

    outer: np.ndarray  # histories x nodes over classes
    inner: np.ndarray  # ending classes x nodes over groups
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << WEIGHT_BITS, np.float32))

    @cached_property
    def to_group(self) -> np.ndarray:
        """The logits on the path to each group of each ending class, a column each."""
        return np.ascontiguousarray(self.inner[:, _TO_GROUP].transpose(1, 0, 2)).reshape(len(_TO_GROUP), -1)

    def turns(self, k: np.ndarray, codes: np.ndarray, history: np.ndarray, f: np.ndarray):
        """The turns that lead to each token: for each feature the first turn that it moves and the places of its weights; logits; whether right.

        First those to its class, for all tokens, level by level; then, for those of ending classes, those to the group.
        """
        e = np.flatnonzero(k >= SINGLE)
        group = groups(codes[e])
        below = (k[e] - SINGLE) * INNER + group
        logits = np.concatenate((self.outer.ravel().take(history * CLASSES + _TO_CLASS.take(k, 1)).ravel(), self.to_group.take(below, 1).ravel()))
        named = _TO_CLASS_NAMED.take(k, 1)
        at = [(0, _places(row ^ named)) for row in f]
        at.append((named.size, _places(f[0][e] ^ _TO_GROUP_NAMED.take(below, 1)) + (1 << (WEIGHT_BITS - 1))))
        for first, places in at:
            logits[first : first + len(places)] += self.weights.take(places)
        return at, logits, np.concatenate((_CLASS_TURNS.take(k, 1).ravel(), _GROUP_TURNS.take(group, 1).ravel()))

    def log10(self, k: np.ndarray, codes: np.ndarray, history: np.ndarray, f: np.ndarray) -> np.ndarray:
        """log10 p(class, group | history) of each token; a single word's group is itself."""
        _, x, right = self.turns(k, codes, history, f)
        x = np.where(right, -x, x).astype(np.float64)
        # a turn's is max(x, 0) + log(1 + exp(-|x|)); the latter's logs are taken of products, of factors from 1 to 2
        more, factors = np.maximum(x, 0), 1 + np.exp(-np.abs(x))
        n = len(_TO_CLASS) * len(k)
        logs = lambda a, b, depth: more[a:b].reshape(depth, -1).sum(0) + np.log(factors[a:b].reshape(depth, -1).prod(0))
        out = logs(0, n, len(_TO_CLASS))
        out[k >= SINGLE] += logs(n, len(x), len(_TO_GROUP))
        return out / -np.log(10)


def _streams(lexicon: Lexicon, texts: list[bytes]):
    """Texts laid end to end, in pieces of PIECE tokens at most: classes, codes, histories, features."""
    distinct, which, starts = laid(texts)
    kinds, codes, _ = lexicon.look_up(distinct)
    k, codes = kinds[which], codes[which]
    yield from _pieces(k, codes, histories(k, starts), features(codes, starts))


#: Turns and turns to the right share one number; a weight may have this many of each.
_RIGHT = 1 << 26


class Tally:
    """Sums by weight over turns: those expected to the right; if observe is set, also those seen to go right, and all."""

    def __init__(self, observe: bool):
        # real: expected; imaginary: all turns + _RIGHT * turns to the right. One access of memory serves all three
        self.packed, self.observe, self.turns = np.zeros(1 << WEIGHT_BITS, complex if observe else float), observe, 0

    def add(self, hashed: Hashed, stream) -> None:
        at, x, right = hashed.turns(*stream)
        p = (1 / (1 + np.exp(-x))).astype(np.float64)
        if self.observe:
            p = p + 1j * (1 + right * float(_RIGHT))
        for first, places in at:
            np.add.at(self.packed, places, p[first : first + len(places)])
            self.turns += len(places)

    def full(self) -> bool:
        """Whether a weight may soon have too many turns to count."""
        if not self.observe or self.turns < _RIGHT // 4:
            return False
        self.turns = 0
        return any((x.imag % _RIGHT).max() > _RIGHT // 2 for x in self.packed.reshape(-1, BLOCK))

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of blocks and their sums, as rows; each block is zero afterwards."""
        for b, x in enumerate(self.packed.reshape(-1, BLOCK)):
            if x.any():
                if self.observe:
                    right, turns = np.divmod(x.imag, _RIGHT)
                    yield b, np.stack((x.real, right, turns))
                else:
                    yield b, x[None].copy()
                x[:] = 0
        self.turns = 0


def _packed(blocks) -> Iterator[pa.RecordBatch]:
    """Blocks, compressed: counts shrink much, and each task's are as large as the model."""
    held = []
    for b, x in blocks:
        held.append((b, zlib.compress(x.astype(np.float32).tobytes(), 1)))
        if len(held) == 200:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["block", "sums"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["block", "sums"])


def _moments(shared_lexicon, shared, observe: bool):
    """The tally of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hashed, found = _lexicon(shared_lexicon), Hashed(*shared.value), Tally(observe)
        for batch in batches:
            for some in _slices(batch.column(0)):
                for stream in _streams(lexicon, some):
                    found.add(hashed, stream)
                    if found.full():
                        yield from _packed(found.blocks())
        yield from _packed(found.blocks())

    return run


def _sum_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(b), np.float32).astype(float)
    yield from _packed((k, total[k]) for k in sorted(total))


def moved(weights: np.ndarray, expected: np.ndarray, seen: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Weights a step up the gradient, which is seen - expected, with the scale of iterative scaling: a turn to a class has FEATURES weights."""
    right = np.log(seen + PRIOR) - np.log(expected + PRIOR)
    left = np.log(turns - seen + PRIOR) - np.log(np.maximum(turns - expected, 0) + PRIOR)
    step = right - left
    step[: len(step) // 2] /= FEATURES
    return (weights + step).astype(np.float32)


def train_hashed(training: DataFrame, shared_lexicon, outer: np.ndarray, inner: np.ndarray) -> Hashed:
    """Weights over hashed features, by one gradient step after each of PASSES passes over all training texts.

    A pass sends the weights out; the tasks' gradients are summed on the executors, in blocks. There
    are no more tasks than cores, as each one's gradient is as large as the model.
    """
    sc = training.sparkSession.sparkContext
    hashed, sums = Hashed(outer, inner), np.zeros((3, 1 << WEIGHT_BITS), np.float32)
    for k in range(PASSES):
        shared = sc.broadcast((hashed.outer, hashed.inner, hashed.weights))
        parts = training.select("text").coalesce(sc.defaultParallelism).mapInArrow(lean(_moments(shared_lexicon, shared, k == 0), "language_model"), "block long, sums binary")
        got = parts.repartition("block").mapInArrow(lean(_sum_moments, "language_model"), "block long, sums binary").toArrow()
        shared.unpersist()
        rows = sums[: 3 if k == 0 else 1]
        rows[:] = 0
        for b, x in zip(got.column(0).to_pylist(), got.column(1)):
            rows[:, b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(zlib.decompress(x.as_buffer()), np.float32).reshape(-1, BLOCK)
        hashed = Hashed(outer, inner, moved(hashed.weights, *sums))
        del parts, got
    return hashed


def _count_classes(shared):
    """Dense class counts of each history met by the task; as large as the model at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        counts = np.zeros(HISTORIES * HISTORIES * CLASSES, np.int64)
        held, size = [], 0
        for batch in batches:
            for some in _slices(batch.column(0)):
                distinct, which, starts = laid(some)
                k = lexicon.look_up(distinct)[0][which]
                held.append(histories(k, starts) * CLASSES + k)
                size += len(k)
                if size > 2_000_000:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        yield from _blobs(counts.reshape(-1, CLASSES))

    return run


def _blobs(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    met = np.flatnonzero(counts.any(1))
    for at in range(0, len(met), 2000):
        some = met[at : at + 2000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([zlib.compress(counts[h].tobytes(), 1) for h in some], pa.binary())], names=["history", "counts"])


def _sum_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(b), np.int64)
            total[h] = total[h] + counts if h in total else counts
    if total:
        found = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([zlib.compress(total[h].tobytes(), 1) for h in found], pa.binary())], names=["history", "counts"])


@dataclass(frozen=True)
class Weights:
    """Softmax weights: a bias, and a row for each value of the n-gram and of the skip feature."""

    bias: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    gram: np.ndarray = field(default_factory=lambda: np.zeros((HISTORIES, CLASSES)))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((HISTORIES, CLASSES)))

    def log_softmax(self, history: np.ndarray) -> np.ndarray:
        x = self.bias + self.gram[history // HISTORIES] + self.skip[history % HISTORIES]
        x -= x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def moved(self, step: np.ndarray) -> Weights:
        s = step.reshape(-1, CLASSES)
        return Weights(self.bias + s[0], self.gram + s[1 : 1 + HISTORIES], self.skip + s[1 + HISTORIES :])


def gradient(weights: Weights, history: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood (natural) and its gradient, as rows bias, gram, skip."""
    log = weights.log_softmax(history)
    rest = counts - counts.sum(1, keepdims=True) * np.exp(log)
    out = np.zeros((1 + 2 * HISTORIES, CLASSES))
    out[0] = rest.sum(0)
    np.add.at(out, 1 + history // HISTORIES, rest)
    np.add.at(out, 1 + HISTORIES + history % HISTORIES, rest)
    return float((counts * log).sum()), out


def _gradients(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, value, total = shared.value, 0.0, np.zeros((1 + 2 * HISTORIES, CLASSES))
        for batch in batches:
            if batch.num_rows:
                counts = np.stack([np.frombuffer(zlib.decompress(b), np.int64) for b in batch.column(1).to_pylist()]).astype(float)
                v, g = gradient(weights, batch.column(0).to_numpy(), counts)
                value, total = value + v, total + g
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([total.tobytes()], pa.binary())], names=["value", "gradient"])

    return run


def train(class_counts: DataFrame, n_tokens: int, updates: int = 15, rate: float = 0.3) -> Weights:
    """Weights fitted by distributed full-batch gradient updates (adaptive steps, the best weights kept).

    class_counts (history, counts) stays on the executors; each update sends the weights out and
    one gradient a task back, both of the model's fixed size.
    """
    sc = class_counts.sparkSession.sparkContext
    weights = best = Weights()
    top, slope, seen = -np.inf, np.zeros((1 + 2 * HISTORIES, CLASSES)), 1e-8
    for k in range(updates if n_tokens else 0):
        shared = sc.broadcast(weights)
        got = class_counts.mapInArrow(lean(_gradients(shared), "language_model"), "value double, gradient binary").toArrow()
        shared.unpersist()
        # summed in a fixed order, as tasks may come back in any
        parts = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
        value = sum(v for v, _ in parts)
        if value > top:
            top, best = value, weights
            slope = np.sum([np.frombuffer(b).reshape(-1, CLASSES) for _, b in parts], axis=0) / n_tokens
            seen = seen + slope**2 * (k > 0)
        else:
            rate /= 2
        weights = best.moved(rate * slope / np.sqrt(seen)) if k else _start(slope, n_tokens)
    return best


def _start(g: np.ndarray, n: int) -> Weights:
    """The first step: from the gradient at zero weights, which holds the feature counts, to smoothed log ratios."""
    share = np.log(np.maximum(g[0] + 1 / CLASSES, 0) + 1 / (n + CLASSES))
    out = []
    for rows in (g[1 : 1 + HISTORIES], g[1 + HISTORIES :]):
        # a row is its counts less their mean, over n
        low = np.minimum(rows.min(1, keepdims=True), 0)
        counts = (rows - low) * n  # exact where some class never follows
        total = counts.sum(1, keepdims=True)
        prior = np.exp(share)
        out.append(np.log((counts + 50 * prior) / (total + 50)) - share)
    return Weights(share, 0.8 * out[0], 0.4 * out[1])


@dataclass(frozen=True)
class Model:
    """What scoring broadcasts, all of fixed size: common counts, class norms, the table of log10 class probabilities."""

    common: list[tuple[bytes, int]]
    single: list[bytes]
    norms: np.ndarray  # R of each class
    table: np.ndarray  # histories x classes, float32
    n_tokens: int
    n_words: int
    hashed: Hashed | None = None
    inner: np.ndarray | None = None  # R of each group of each ending class


def fit(docs: DataFrame, hashed: bool = False) -> tuple[Model, DataFrame]:
    """The model of the rows that are not held out, and their token counts (word, c), computed once.

    With hashed=True both factors also follow hashed features of the real words before.
    """
    sc = docs.sparkSession.sparkContext
    training = texts(docs).where(~held_out())
    counts = cut(count_tokens(training))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    got = counts.orderBy(F.desc("c"), "word").limit(COMMON).toArrow()
    common = list(zip(got.column("word").to_pylist(), got.column("c").to_pylist()))
    common = [*([(END, ends)] if ends else []), *((w, c) for w, c in common if w != END)]
    single = [w for w, _ in common[:SINGLE]] or [END]
    shared = sc.broadcast((_key(common), common, single))
    blobs = training.select("text").mapInArrow(lean(_count_classes(shared), "language_model"), "history long, counts binary")
    class_counts = cut(blobs.repartition("history").mapInArrow(lean(_sum_blobs, "language_model"), "history long, counts binary")).coalesce(8)
    weights = train(class_counts, n)
    norms = np.ones(CLASSES)
    group = F.xxhash64("right_bytes").bitwiseAND(ENDINGS - 1)
    sized = counts.withColumn("right_bytes", F.expr("substring(word, greatest(length(word) - 2, 1), 3)"))
    for row in sized.groupBy(group.alias("g")).agg(F.sum(F.col("c") + 1).alias("r")).collect():
        norms[SINGLE + row.g] += row.r
    for k, (w, c) in enumerate(common[:SINGLE]):
        norms[k] = c + 1
        if c:
            norms[SINGLE + _ending(w)] -= c + 1
    table = np.concatenate([weights.log_softmax(np.arange(a, min(a + 4096, HISTORIES**2))) for a in range(0, HISTORIES**2, 4096)])
    model = Model(common, single, norms, (table / np.log(10)).astype(np.float32), int(n), int(v))
    if not hashed:
        return model, counts
    inner = np.ones((ENDINGS, INNER))
    sub = F.shiftrightunsigned(F.xxhash64("word"), 32).bitwiseAND(INNER - 1)
    for row in sized.groupBy(group.alias("g"), sub.alias("s")).agg(F.sum(F.col("c") + 1).alias("r")).collect():
        inner[row.g, row.s] += row.r
    for w, c in common[:SINGLE]:
        if c:
            inner[_ending(w), _code(w) >> 32 & (INNER - 1)] -= c + 1
    start = odds(np.exp(table)), odds(inner / inner.sum(1, keepdims=True))
    return replace(model, hashed=train_hashed(training, shared, *start), inner=inner), counts


def _key(common) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(common).encode())


_ROWS = pa.schema([("key", pa.int64()), ("word", pa.binary()), ("k", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("model", pa.float64())])


def _parts(lexicon: Lexicon, table: np.ndarray, norms: np.ndarray, hashed: tuple | None, inner: np.ndarray | None):
    """Texts to their distinct tokens, the logs of these, which of them each token is, where texts begin, and the parts of their scores that aren't the tokens' own counts."""
    norms, flat = np.log10(norms), table.ravel()
    model, inner = hashed and Hashed(*hashed), None if inner is None else np.log10(inner)

    def parts(texts):
        distinct, which, starts = laid(texts)
        kinds, codes, logs = lexicon.look_up(distinct)
        k = kinds[which]
        history = histories(k, starts)
        if model is None:
            each = flat[history * CLASSES + k].astype(np.float64) - norms[k]
        else:
            shares = np.where(kinds < SINGLE, norms[kinds], inner[np.maximum(kinds - SINGLE, 0), groups(codes)])
            codes = codes[which]
            each = np.concatenate([model.log10(*piece) for piece in _pieces(k, codes, history, features(codes, starts))]) - shares[which]
        return distinct, logs, which, starts, np.add.reduceat(each, starts)

    return parts


def _pieces(*columns: np.ndarray):
    """Columns, whose last axis is the tokens', cut into pieces."""
    for a in range(0, columns[0].shape[-1], PIECE):
        yield [x[..., a : a + PIECE] for x in columns]


def _score(shared_lexicon, shared_table):
    """For each text a row with the sums over its common tokens, and one for each of its other words to be joined.

    The row of a text has a word that no text holds, so that it meets no count and rows spread evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon = _lexicon(shared_lexicon)
        parts, key = _parts(lexicon, *shared_table.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for some in _slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(some)).to_pylist()
                at += len(some)
                distinct, own, which, starts, model = parts(some)
                rare = np.isnan(own)
                n = np.diff(np.append(starts, len(which)))
                logs = np.add.reduceat(np.where(rare, 0, own)[which], starts)
                place = np.flatnonzero(rare[which])
                text = np.searchsorted(starts, place, "right") - 1
                # each text's rare tokens, and how often it has them
                pair, times = np.unique(text * len(distinct) + which[place], return_counts=True)
                text, word = pair // len(distinct), pair % len(distinct)
                m = np.bincount(text, times, len(some)).astype(np.int64)
                keys = key + np.arange(len(some))
                key += len(some)
                no, zero = [None] * len(pair), np.zeros(len(pair))
                columns = (np.concatenate((keys, keys[text])), [b" %d" % x for x in keys.tolist()] + [distinct[i] for i in word.tolist()], np.concatenate((np.zeros(len(some), np.int64), times)),
                           ids + no, n.tolist() + no, np.concatenate((n - m, zero.astype(np.int64))), np.concatenate((logs, zero)), np.concatenate((model, zero)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ROWS)], schema=_ROWS)

    return run


def score(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Null text is empty: its end is its only token. A null doc_id is held out. Without training
    rows every count is zero and the base of any text is log10 of one; the model's classes are
    then equally likely. Rows with the same id are scored one by one; extra columns are ignored.
    With hashed=True the score is of the model with hashed features, else of its classes alone.
    """
    sc = docs.sparkSession.sparkContext
    model, counts = fit(docs, hashed)
    lexicon = sc.broadcast((_key(model.common), model.common, model.single))
    m = model.hashed
    table = sc.broadcast((model.table, model.norms, m and (m.outer, m.inner, m.weights), model.inner))
    rows = texts(docs).mapInArrow(lean(_score(lexicon, table), "language_model"), "key long, word binary, k long, doc_id long, n_tokens long, known long, logs double, model double")
    c = F.coalesce("c", F.lit(0))
    sums = rows.join(counts, "word", "left").groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("k")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.col("k") * F.log10(c + 1)).alias("logs"), F.sum("model").alias("model"),
    )
    whole = float(np.log10(model.n_tokens + model.n_words + 1))
    return sums.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"),
    )

"""SimHash near-duplicates, joined exactly with pivot distance tables.

A fingerprint's row of the table has its Hamming distances to many reference fingerprints. No
coordinate of two linked rows differs by more than the bits in which they do. BLOCKS references
are the first one with two bits flipped, each in a place of its own: a difference in two bits
changes at most two of their coordinates (less the first's), so that of six groups of coordinates
four agree, and these are the cells in which pairs are sought. The other references lie anywhere;
pairs whose rows differ by more than two in any of them are discarded, and survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, lean, spare, texts
from tidelog.llm.components import components

SEED = 42
#: Bits in which linked fingerprints may differ.
MAX_BITS = 2
#: References that differ from the first in two bits each; the groups in which their coordinates are compared.
BLOCKS, GROUPS = 32, 6
#: Other references.
SCATTERED = 24
#: A cell of at most this many distinct fingerprints is joined pair by pair; a larger one through its one-bit neighbours.
CELL = 128

_BYTE = (np.arange(8) * 256).astype(np.uint16)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of UTF-8 text: over the XXH64 of its word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    cuts = map(slice, (ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist())
    n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, cuts), repeat(SEED)), np.uint64, n)
    counts = np.zeros(2048, np.int64)
    for at in range(0, n, 1 << 20):  # bounded memory for very long texts
        counts += np.bincount((hashes[at : at + (1 << 20)].astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    bits = (counts.reshape(8, 256) @ _BITS).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row; null text: empty, fingerprint zero."""
    return texts(docs).mapInArrow(lean(_fingerprints(width), "simhash"), "doc_id long, fp long")


def pivots(n: int) -> list[int]:
    """n reference fingerprints, from a fixed rule: multiples of the odd golden-ratio constant."""
    return [((k * 0x9E3779B97F4A7C15) ^ (k * 0xC2B2AE3D27D4EB4F >> 3)) & (2**64 - 1) for k in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _distance(p: int):
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)).cast("bigint")))


def _distances(n: int):
    """The part of a row of the pivot table that belongs to the scattered references, a byte each."""
    return F.array(*(_distance(p).cast("tinyint") for p in pivots(n + 1)[1:]))


def celled(distinct: DataFrame) -> DataFrame:
    """(fp, cell): the cells that a linked pair may share, for each choice of GROUPS - MAX_BITS groups of coordinates what these are.

    The distance to a reference with a block of two bits flipped is that to the first, plus two,
    less twice the bits of the block that differ from the first's.
    """
    base = pivots(1)[0]
    rows = distinct.select("fp", (_distance(base) + 2).alias("first"))
    coordinates = [F.shiftright(F.col("first") - _distance(base ^ (3 << (2 * j))), 1) for j in range(BLOCKS)]
    groups = [reduce(lambda n, c: n * 3 + c, coordinates[g::GROUPS]).cast("bigint").alias(f"g{g}") for g in range(GROUPS)]
    rows = rows.select("fp", F.array(*groups).alias("g"))
    chosen = F.lit([list(c) for c in combinations(range(GROUPS), GROUPS - MAX_BITS)])
    cells = F.transform(chosen, lambda c, k: F.aggregate(c, k.cast("bigint"), lambda n, g: F.shiftleft(n, 10).bitwiseOR(F.get("g", g))))
    return rows.select("fp", F.explode(cells).alias("cell"))


def discarded(x: str, y: str, n: int = SCATTERED):
    """Whether some difference of the n coordinates of two rows, and so the greatest, says that they can't be linked."""
    return F.exists(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: F.abs(a - b)), lambda d: d > MAX_BITS)


def candidates(cells: DataFrame, n_pivots: int = SCATTERED) -> DataFrame:
    """(u, v, du, dv) of all pairs u > v of a cell, with their rows of the table."""
    rows = cells.withColumn("d", _distances(n_pivots))
    a, b = (rows.select("cell", F.col("fp").alias(v), F.col("d").alias(f"d{v}")) for v in "uv")
    return a.join(b, "cell").where("u > v").drop("cell")


def links(distinct: DataFrame, n_pivots: int = SCATTERED, cell: int = CELL) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (fp) that connect exactly those with at most two differing bits.

    Small cells: all pairs of a cell, less those that the pivot table discards; survivors are
    verified. Large cells: each fingerprint meets its neighbours at their common one-bit variants,
    and is linked to the smallest there: fingerprints sharing a variant differ by two bits at most,
    and any that do share one. So no group is ever expanded into its pairs, and no link is lost.
    """
    keyed = celled(distinct)
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(keyed.join(sizes, "cell"))
    near = candidates(live.where(F.col("n") <= cell).select("cell", "fp"), n_pivots).where(~discarded("du", "dv", n_pivots)).select("u", "v").distinct()
    pairs = near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    crowd = live.where(F.col("n") > cell).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)).cast("bigint") for i in range(64)))
    variants = crowd.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = variants.join(least, "variant").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp bigint, component_id) of every row of docs.

    Rows whose fingerprints differ by two bits at most are linked; component_id is the smallest
    doc_id reachable. Equal fingerprints are one node, so copies cost one row each. Null text counts
    as empty; rows without words share fingerprint zero. A null doc_id stays null and never names
    a component; a group of nulls alone has component null. Other columns are ignored.
    """
    rows = cut(fingerprints(docs, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = components(links(distinct.select("fp")))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _keyed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = next(_fingerprints(width)(iter([batch.select(["doc_id", "text"])])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found.column(1)], names=["doc_id", "h", "fp"])


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id.

    Keeps all columns. Rows are told apart by doc_id and text, so rows that share an id go or stay
    one by one; of one id's texts in a group the one with the smallest hash stays, and of equal
    rows any one. Rows with a null doc_id are kept, as they can't be told apart.
    """
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(lambda b: _keyed(b, width), "simhash"), "doc_id long, h long, fp long")
    rows = cut(keyed.where("doc_id is not null").groupBy("doc_id", "h").agg(F.min("fp").alias("fp"), F.count("*").alias("n")))
    first = F.min(F.struct("doc_id", "h")).alias("first")
    distinct = cut(rows.groupBy("fp").agg(first))
    parts = components(links(distinct.select("fp")))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    kept = named.join(named.groupBy("component").agg(F.min("first").alias("kept")), "component").select("fp", "kept")
    doc, text = spare(docs.columns, "doc"), spare(docs.columns, "hash")
    keys = rows.join(kept, "fp").select(F.col("doc_id").alias(doc), F.col("h").alias(text), (F.struct("doc_id", "h") != F.col("kept")).alias("gone"), "n")
    here = [docs["doc_id"].cast("bigint"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))]

    def join(right: DataFrame, how: str) -> DataFrame:
        return docs.join(right, (here[0] == right[doc]) & (here[1] == right[text]), how)

    gone = keys.where("gone").select(doc, text)
    if rows.where("n > 1").isEmpty():
        return join(gone, "left_anti")
    again = cut(keys.where("n > 1 and not gone").select(doc, text))
    once = join(again, "inner").dropDuplicates([doc, text]).select(*(docs[c] for c in docs.columns))
    return join(gone.unionByName(again), "left_anti").unionByName(once)

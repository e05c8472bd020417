"""Benchmark decontamination: size-partitioned MinHash containment search.

Both sides are partitioned by size: items by the number of their shingles, documents by theirs, in powers of two.
For each pair of partitions a one-permutation MinHash is used whose number of bins follows the largest document
of the partition and the smallest item of the other: a shingle of the document is kept as the minimum of its bin
with a probability f, and f is set so that an item whose containment reaches the threshold keeps none of its
shared shingles with probability ``miss`` at most. So a short item is found in a document of any length. Items
that share a bin minimum with a document are candidates; they are verified by exact containment on full sets. An item
of fewer words than a shingle has is one shingle of its own length; it is looked up among the document's shingles of
that length.

The items are small next to the documents; they are taken in blocks of at most ``block`` shingles, and each block's
index is broadcast. The documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import textkit
from edgetide.llm.neardup import portions
from edgetide.llm.runtime import prepare, stage

FOUND = "doc_id long, item_id long, item_shingles long, shared long"
_U = np.uint64


def load_for(keep: float) -> float:
    """Shingles per bin at which a shingle is its bin's minimum with probability ``keep``: (1 - exp(-x)) / x = keep."""
    low, high = 0.0, 50.0
    for _ in range(60):
        x = (low + high) / 2
        if x == 0 or -math.expm1(-x) / x > keep:
            low = x
        else:
            high = x
    return low


def minima(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of every bin that is not empty; ``shingles`` are sorted, and a bin is a range of hashes."""
    if bins >= 1 << 31:
        return shingles
    of = ((shingles >> _U(32)) * _U(bins)) >> _U(32)
    return shingles[np.r_[True, of[1:] != of[:-1]]] if len(of) else shingles


class Index:
    """Sorted shingle sets of a block of items, and their bin minima for every partition of document sizes."""

    def __init__(self, ids: list[int], short: list[int], sets: list[np.ndarray], num: int, den: int, miss: float):
        self.ids, self.num, self.den, self.miss = ids, num, den, miss
        self.short = {}
        for words in sorted(set(short) - {0}):
            members = [i for i, k in enumerate(short) if k == words]
            hashes = np.concatenate([sets[i] for i in members])
            order = np.argsort(hashes, kind="stable")
            self.short[words] = hashes[order], np.array(members)[order]
        # short items keep their place but have no part
        sets = [s[:0] if k else s for s, k in zip(sets, short)]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.parts = {int(p): np.flatnonzero(np.ceil(np.log2(np.maximum(self.size, 1))) == p) for p in np.unique(np.ceil(np.log2(np.maximum(self.size[self.size > 0], 1))))}
        self.known: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}

    def items(self, k: int) -> np.ndarray:
        return self.flat[self.at[k] : self.at[k + 1]]

    def probe(self, part: int, size_class: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Bins for documents of up to 2**size_class shingles, and the items' minima, sorted, with their items."""
        if (part, size_class) not in self.known:
            members = self.parts[part]
            smallest = int(self.size[members].min())
            shared = -(-self.num * smallest // self.den)
            keep = 1 - self.miss ** (1 / max(1, shared))
            bins = max(1, math.ceil((1 << size_class) / max(load_for(keep), 1e-12)))
            own = [minima(self.items(k), bins) for k in members]
            hashes, owner = np.concatenate(own), np.repeat(members, [len(o) for o in own])
            order = np.argsort(hashes, kind="stable")
            self.known[part, size_class] = bins, hashes[order], owner[order]
        return self.known[part, size_class]

    def search_short(self, words: int, doc: np.ndarray) -> list[tuple[int, int]]:
        """The items of so many words among a document's sorted shingles of as many words."""
        hashes, owner = self.short[words]
        lo, hi = np.searchsorted(hashes, doc), np.searchsorted(hashes, doc, side="right")
        return [(int(k), 1) for k in owner[textkit.runs(lo, hi - lo)[0]]]

    def search(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for the items contained in a document, given its sorted shingle set."""
        found = []
        size_class = max(0, math.ceil(math.log2(len(doc))))
        for part in self.parts:
            bins, hashes, owner = self.probe(part, size_class)
            mine = minima(doc, bins)
            lo = np.searchsorted(hashes, mine)
            hit = lo < len(hashes)
            hit[hit] = hashes[lo[hit]] == mine[hit]
            if not hit.any():
                continue
            hi = np.searchsorted(hashes, mine[hit], side="right")
            for k in np.unique(owner[textkit.runs(lo[hit], hi - lo[hit])[0]]):
                item = self.items(k)
                at = np.searchsorted(doc, item)
                shared = int((doc[np.minimum(at, len(doc) - 1)] == item).sum())
                if self.den * shared >= self.num * len(item):
                    found.append((int(k), shared))
        return found


def _sets(words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, low, high = textkit.words(*textkit.view(batch.column("text")))
            sets = textkit.distinct(*textkit.shingles(h, low, high, words))
            # 0: long enough; else the words of a short item, whose shingle is its own
            short = np.where(high - low < words, high - low, 0)
            for k in range(1, words):
                if (short == k).any():
                    own, at = textkit.shingles(h, low, high, k)
                    for i in np.flatnonzero(short == k):
                        sets[i] = own[at[i] : at[i + 1]]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(short, pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "n", "short", "shingles"])

    return each


def _search(shared_index, words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared_index.value
        for batch in batches:
            data, starts, ends = textkit.view(batch.column("text"))
            rows = []
            for lo, hi in portions(starts, ends):
                h, low, high = textkit.words(data, starts[lo:hi], ends[lo:hi])
                if index.parts:
                    # a document of fewer words than a shingle holds no item of more
                    long = high - low >= words
                    flat, at = textkit.shingles(h, low, np.where(long, high, low), words)
                    for i, doc in enumerate(textkit.distinct(flat, at)):
                        if len(doc):
                            rows += [(lo + i, k, shared) for k, shared in index.search(doc)]
                for n in index.short:
                    flat, at = textkit.shingles(h, low, np.where(high - low >= n, high, low), n)
                    for i, doc in enumerate(textkit.distinct(flat, at)):
                        rows += [(lo + i, k, shared) for k, shared in index.search_short(n, doc)]
            at = pa.array([r[0] for r in rows], pa.int64())
            found = {c: batch.column(c).take(at) for c in batch.schema.names if c != "text"}
            found |= {"item_id": pa.array([index.ids[r[1]] for r in rows], pa.int64()), "item_shingles": pa.array([max(1, int(index.size[r[1]])) for r in rows], pa.int64()), "shared": pa.array([r[2] for r in rows], pa.int64())}
            yield pa.RecordBatch.from_arrays([*found.values()], names=[*found])

    return each


def item_blocks(items: DataFrame, words: int, block: int) -> Iterator[list]:
    """The items' shingle sets in blocks of at most ``block`` shingles (a larger item is a block of its own)."""
    ready = stage(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_sets(words), "item_id long, n long, short int, shingles binary").where("n > 0"), "items")
    held, total = [], 0
    for row in ready.toLocalIterator():
        if held and total + row.n > block:
            yield held
            held, total = [], 0
        held.append(row)
        total += row.n
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, num: int = 4, den: int = 5, miss: float = 1e-6, block: int = 2_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, item_id, item_shingles, shared for every document that contains num/den of an item's shingles or more.

    docs (doc_id, text) and items (item_id, text); more columns are ignored, but for those of docs that ``keep`` names
    (long ones), which come along. A-Z are lower-cased and words split at space and bytes 9 to 13. An item of fewer than
    ``words`` words is one shingle, found wherever these words follow each other. Null or empty texts have no shingle and
    no link; an empty table on either side gives no rows. Repeated rows and repeated items give a row each; null ids
    stay null. A text of any length is searched whole, a portion of documents at a time.
    """
    spark = prepare(docs.sparkSession)
    kept = "".join(f"{c} long, " for c in keep)
    schema = FOUND.replace("doc_id long, ", f"doc_id long, {kept}")
    side = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    out = None
    for rows in item_blocks(items, words, block):
        index = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.short for r in rows], [np.frombuffer(r.shingles, np.uint64) for r in rows], num, den, miss))
        found = side.mapInArrow(_search(index, words), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)

"""Benchmark decontamination: item-sized windows of documents against benchmark items.

A text is its words (runs of letters, digits and underscores, lower-cased), a
window its multiset of five-word shingles (all its words as one shingle if an
item has fewer). For every item of L words, each window of L words is a
candidate place; a text of fewer words is one window as a whole. Windows without any shingle of any item have similarity zero
and are passed over; each other window gets a SimHash fingerprint of 128 bits,
summed over its weighted shingles (weight: times in the window). Fingerprints
are looked up in eight blocks of 16 bits, each with all values at up to four
differing bits listed: a fingerprint within RADIUS bits of an item's must agree
that closely in some block, so none is missed. Items found are verified by the
exact weighted Jaccard similarity, sum of least over sum of greatest weights.

A benchmark of at most BLOCK_ITEMS items and BLOCK_CHARS characters is broadcast.
A larger one stays a table: shingles of documents (those that a filter of bounded
size doesn't rule out) meet those of items in a join, an item similar enough has to share
at least ``similarity`` of its shingles with a text, and each such pair's windows are then compared
in the same way. The documents are read twice, whatever the number of items.

Rows that repeat a document id or an item id count as one each, with the best
window of all. Very long texts are compared whole, window by window in pieces.
Texts null or without words, and items without words, match nothing. Of a
document's windows for one item the most similar counts, the first if they tie.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .membership import Bits, filter_of, mixed

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCK_BITS, NEAR = 128, 16, 4
#: Eight blocks that each differ in five bits or more make 40. Two windows at the similarity of 0.8 differ in 19 bits on average, with a deviation of 4.
RADIUS = (NEAR + 1) * (BITS // BLOCK_BITS) - 1
#: Items and characters up to which a benchmark is broadcast.
BLOCK_ITEMS, BLOCK_CHARS = 1024, 4 << 20
_SCHEMA = "doc_id long, item_id long, similarity double, at_word long"
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def text_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ ids[i : len(ids) - width + 1 + i]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return mixed(h)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 128 bits of each shingle."""
    both = np.stack([mixed(hashes), mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Blocks (uint16) of the SimHash of each window of ``size`` shingles."""
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(hashes), axis=0)])
    return np.packbits(sums[starts + size] > sums[starts], axis=1).view(np.uint16)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least)


class Items:
    """The index of one block of items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.by_length: dict[int, list[int]] = defaultdict(list)
        self.ids: list[int] = []
        self.shingles: list[Counter] = []
        prints, owners = [], defaultdict(set)
        for item_id, text in rows:
            words = text_words(text)
            if not words:
                continue
            width = min(SHINGLE, len(words))
            h = shingle_hashes(np.array([self._id(w) for w in words], np.uint64), width)
            self.by_length[len(words)].append(len(self.ids))
            self.ids.append(item_id)
            self.shingles.append(Counter(h.tolist()))
            prints.append(fingerprints(h, np.array([0]), len(h))[0])
            for x in set(h.tolist()):
                owners[width, x].add(len(words))
        self.prints = np.array(prints, np.uint16).reshape(-1, BITS // BLOCK_BITS)
        self.widths = {w: np.array(sorted(x for v, x in owners if v == w), np.uint64) for w in {v for v, _ in owners}}
        self.lengths_of = owners
        self.tables = self._tables()

    def _id(self, word: str) -> int:
        return self.vocabulary.setdefault(word, xxhash.xxh3_64_intdigest(word.encode()))

    def _tables(self) -> np.ndarray:
        """By block and block value: the set of items within NEAR bits, as bits."""
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint32)
        near = values[np.bitwise_count(values) <= NEAR]
        out = np.zeros((self.prints.shape[1], 1 << BLOCK_BITS, -(-max(len(self.ids), 1) // 8)), np.uint8)
        for i, row in enumerate(self.prints):
            for b, value in enumerate(row):
                out[b, near ^ value, i // 8] |= 1 << i % 8
        return out

    def matches(self, text: str | None, similarity: float) -> list[tuple[int, float, int]]:
        """(item id, similarity, first word of the window) of each item in the text."""
        words = text_words(text)
        if not words:
            return []
        found: dict[int, tuple[float, int]] = {}
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        for width, known in self.widths.items():
            if len(ids) < width:
                continue
            full = ids != 0
            run = full[: len(ids) - width + 1].copy()
            for i in range(1, width):
                run &= full[i : len(ids) - width + 1 + i]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            local = np.stack([ids[at + i] for i in range(width)])
            h = np.full(len(at), width, np.uint64)
            for part in local:
                h = (h ^ part) * _MULTIPLIER
                h ^= h >> np.uint64(29)
            h = mixed(h)
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            starts_of: dict[int, set[int]] = defaultdict(set)
            for p, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                for length in self.lengths_of[width, x]:
                    starts_of[length].update(range(max(0, p - length + width), min(p, max(0, len(words) - length)) + 1))
            for length, starts in starts_of.items():
                if starts:
                    self._windows(words, np.array(sorted(starts)), length, width, similarity, found)
        return [(self.ids[i], s, at) for i, (s, at) in sorted(found.items())]

    def _windows(self, words: list[str], starts: np.ndarray, length: int, width: int, similarity: float, found: dict[int, tuple[float, int]]) -> None:
        span = min(length, len(words))
        size = span - width + 1
        own = self.by_length[length]
        wanted = np.zeros(self.tables.shape[2], np.uint8)
        for i in own:
            wanted[i // 8] |= 1 << i % 8
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):  # windows far apart share no words
            for some in np.array_split(part, -(-len(part) // 4096)):
                first = int(some[0])
                region = words[first : int(some[-1]) + span]
                h = shingle_hashes(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in region], np.uint64), width)
                prints = fingerprints(h, some - first, size)
                near = np.zeros((len(some), self.tables.shape[2]), np.uint8)
                for b in range(prints.shape[1]):
                    near |= self.tables[b, prints[:, b]]
                near &= wanted
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    items = np.flatnonzero(np.unpackbits(near[k], bitorder="little"))
                    apart = np.bitwise_count(self.prints[items] ^ prints[k]).sum(axis=1)
                    items = items[apart <= RADIUS].tolist()
                    if items:
                        start = int(some[k])
                        window = Counter(h[start - first : start - first + size].tolist())
                        for i in items:
                            s = weighted_jaccard(window, self.shingles[i])
                            if s >= similarity and (i not in found or (-s, start) < (-found[i][0], found[i][1])):
                                found[i] = (s, start)


def _known_shingles(items: DataFrame) -> DataFrame:
    """item_id, ``h`` (a shingle's hash, which tells the width, too), its ``weight``, the item's ``total`` of weights and its ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, weights, totals, widths = [], [], [], [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text_words(text)
                if words:
                    width = min(SHINGLE, len(words))
                    found = Counter(shingle_hashes(_word_ids(words), width).view(np.int64).tolist())
                    ids += [item_id] * len(found)
                    hashes += found.keys()
                    weights += found.values()
                    totals += [found.total()] * len(found)
                    widths += [width] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hashes, weights, totals, widths)], names=["item_id", "h", "weight", "total", "width"])

    return items.mapInArrow(run, "item_id long, h long, weight long, total long, width long")


def _word_ids(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def _met(docs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """doc_id and item_id of texts that hold enough of an item's shingles, wherever they stand."""
    widths = [r["width"] for r in known.select("width").distinct().collect()]  # SHINGLE at most
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(known, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(*shared.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = _word_ids(text_words(text.as_py()))
                for width in widths:
                    if len(ids) >= width:
                        h = np.unique(shingle_hashes(ids, width))
                        h = h[bits.has(h)]
                        if len(h):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc_id.as_py())), pa.array(h.view(np.int64))], names=["doc_id", "h"])

    hits = docs.mapInArrow(run, "doc_id long, h long").distinct().join(known, "h")
    return hits.groupBy("doc_id", "item_id", "total").agg(F.sum("weight").alias("held")).where(F.col("held") >= similarity * F.col("total") - 1e-9).select("doc_id", "item_id")


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``similarity`` and ``at_word``.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are
    not read. Rows with a null id are passed over on both sides.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long"), "text").where("doc_id is not null and text is not null")
    items = items.select(items["item_id"].cast("long"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if size["n"] <= BLOCK_ITEMS and (size["chars"] or 0) <= BLOCK_CHARS:
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()])
        found = docs.mapInArrow(_matcher(shared, similarity), _SCHEMA)
    else:
        met = stored(_met(docs, stored(_known_shingles(items).distinct()), similarity))
        bits = spark.sparkContext.broadcast(filter_of(met, "doc_id"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = Bits(*bits.value)
            for batch in batches:
                yield batch.filter(pa.array(wanted.has(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

        pairs = docs.mapInArrow(near, docs.schema).join(met, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
        found = pairs.select("doc_id", "text", "item_id", "item").sortWithinPartitions("item_id", "item").mapInArrow(_pair_matcher(similarity), _SCHEMA)
    best = F.max_by(F.struct("similarity", "at_word"), F.struct("similarity", -F.col("at_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "at_word"])


def _matcher(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value)
        for batch in batches:
            yield _batch([(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in index.matches(t.as_py(), similarity)])

    return run


def _pair_matcher(similarity: float):
    """Rows of doc_id, text, item_id and item, sorted by item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            rows = []
            for doc_id, text, item_id, item in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = item_id.as_py(), item.as_py()
                if own != last:
                    last, index = own, Items([own])
                rows += [(doc_id.as_py(), *m) for m in index.matches(text.as_py(), similarity)]
            yield _batch(rows)

    return run

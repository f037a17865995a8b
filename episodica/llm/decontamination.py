"""Passages of benchmark items inside documents: SimHash windows, Hamming blocks, exact verification.

An item of ``L`` words may differ from a document's passage only so far that the weighted Jaccard similarity of their
five-word shingles stays at ``THRESHOLD`` or more.  That bounds the changed shingles, hence the separate edits, hence
the longest run of words that both share from below (:func:`shared_run`).  Window and stride of an item's size class
are chosen such that some window on the document's stride lies inside every such run; its fingerprint is then within
the radius of one of the item's own windows (all offsets are indexed).  ``RADIUS + 1`` blocks of the fingerprint
find every fingerprint within the radius, by the pigeonhole principle.  Each candidate places the item in the
document; the exact similarity of the best-placed window decides.  A passage that stands in several places of a document
is found at each; of spans of one item that share words the most similar counts.

Windows as long as the item itself would not do: at a similarity of 0.8 two such fingerprints differ in 9.7 of 64 bits on
average (an angle of arccos(8/9)) with a deviation of 2.9, and the blocks for a radius of 18 are three bits and select nothing.
Windows that fit the shared run are equal in a match, so that the blocks' guarantee covers every match.

The items are a stated query set: they pass through the documents in blocks of bounded size, with no join.

Defined cases: null or empty texts match nothing; items of fewer than five words have all their words as the one
shingle and match exact runs; items without words match nothing; equal items match each under its own id; repeated
rows match alike; empty tables give no matches; all columns are carried through.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, text_or_empty
from .near_duplicates import SHINGLE, THRESHOLD, shingle_hashes, weighted_jaccard

RADIUS = 2
BLOCKS = RADIUS + 1
#: First bit and number of bits of each block.
SPANS = tuple((k * 64 // BLOCKS, (k + 1) * 64 // BLOCKS - k * 64 // BLOCKS) for k in range(BLOCKS))
#: Windows in words, from long to short; an item takes the first that its longest shared run admits.
WINDOWS = (96, 64, 44, 32, 24, 20, 16, 12, 10, 8, 6, 5, 4, 3, 2, 1)
#: Items whose windows are searched together, and words fingerprinted in one numpy step.
ITEMS_PER_BLOCK = 4000
STEP_WORDS = 30_000


def stride(window: int) -> int:
    return max(1, window // 3) if window > SHINGLE else 1


def tolerated(length: int, edits: int = 0) -> int:
    """Words that a match may lack at an item's ends, beside ``edits`` between them.

    Of the item's m shingles an inserted word changes four and adds five to the passage, and no edit changes less:
    with x lost at the ends the similarity is at most (m - 4 edits - x) / (m + 5 edits).
    """
    m = max(1, length - SHINGLE + 1)
    return int(m * (1 - THRESHOLD) - edits * (SHINGLE - 1 + THRESHOLD * SHINGLE) + 1e-9)


def shared_run(length: int) -> int:
    """Words of the longest run that an item must share with a passage that it matches."""
    m = max(1, length - SHINGLE + 1)
    most = int(m * (1 - THRESHOLD) / (SHINGLE - 1 + THRESHOLD * SHINGLE) + 1e-9)
    return max(1, min((length - tolerated(length, e) - e) // (e + 1) for e in range(most + 1)))


def size_class(length: int) -> int:
    run = shared_run(length)
    return next(w for w in WINDOWS if w + stride(w) - 1 <= run)


def word_hashes(text: Column) -> Column:
    """Hashes of the words of letters, marks and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def level_sums(shingles: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """For each power of two up to ``most``, how often each bit is set in so many shingles from each place.

    A window has fewer than 256 shingles, so bytes hold the counts.
    """
    out = {1: np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)}
    k = 1
    while 2 * k <= most and len(out[k]) > k:
        out[2 * k] = out[k][:-k] + out[k][k:]
        k *= 2
    return out


def fingerprints(levels: dict[int, np.ndarray], starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of ``count`` shingles from each start: the majority of each bit."""
    ones, at = None, starts
    for k in (1 << b for b in reversed(range(count.bit_length())) if count >> b & 1):
        part = levels[k][at]
        ones = part if ones is None else ones + part
        at = at + k
    return np.packbits(ones > count // 2, axis=1).view(np.uint64).ravel()


@dataclass
class _Class:
    window: int
    prints: np.ndarray  # of all windows of the class's items
    item: np.ndarray
    offset: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each block: a bit for each value that occurs, sorted values, their windows


def _block(prints: np.ndarray, k: int) -> np.ndarray:
    first, size = SPANS[k]
    return ((prints >> np.uint64(first)) & np.uint64((1 << size) - 1)).view(np.int64)


class Index:
    """Windows of a block of items, by size class."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        self.shingles = [shingle_hashes(x) for x in items]
        self.counted = [np.unique(x, return_counts=True) for x in self.shingles]
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, x in enumerate(items):
            if len(x):
                rows.setdefault(size_class(len(x)), []).append((x, i))
        self.classes = []
        for w, members in sorted(rows.items()):
            prints, item, offset = [], [], []
            for x, i in members:
                count = max(1, w - SHINGLE + 1)
                starts = np.arange(len(x) - w + 1)
                prints.append(fingerprints(level_sums(self._features(x, w), count), starts, count))
                item.append(np.full(len(starts), i))
                offset.append(starts)
            p = np.concatenate(prints)
            tables = []
            for k in range(BLOCKS):
                value = _block(p, k)
                order = np.argsort(value, kind="stable")
                occurs = np.zeros(1 << SPANS[k][1], bool)
                occurs[value] = True
                tables.append((np.packbits(occurs, bitorder="little"), value[order], order))
            self.classes.append(_Class(w, p, np.concatenate(item), np.concatenate(offset), tables))

    @staticmethod
    def _features(words: np.ndarray, window: int) -> np.ndarray:
        """Features of which a window of ``window`` words has max(1, window - 4): shingles, or runs of its length."""
        return shingle_hashes(words, min(SHINGLE, window))

    def placements(self, words: np.ndarray, doc_starts: np.ndarray, doc_sizes: np.ndarray) -> np.ndarray:
        """Rows (document, item, first word in the document) that a window within the radius proposes."""
        found = [np.zeros((0, 3), np.int64)]
        levels: dict[int, dict[int, np.ndarray]] = {}
        most = max((max(1, c.window - SHINGLE + 1) for c in self.classes), default=1)
        for c in self.classes:
            step, n = stride(c.window), np.maximum(doc_sizes - c.window + 1, 0)
            n = -(-n // step)
            if not n.sum():
                continue
            # Place of each window: the step, or the jump from the last window of a text to the first of the next.
            some = np.flatnonzero(n)
            jump = np.full(n.sum(), step)
            firsts = np.cumsum(n[some]) - n[some]
            jump[firsts[1:]] = doc_starts[some[1:]] - doc_starts[some[:-1]] - (n[some[:-1]] - 1) * step
            jump[0] = doc_starts[some[0]]
            at = np.cumsum(jump)
            size, count = min(SHINGLE, c.window), max(1, c.window - SHINGLE + 1)
            if size not in levels:
                levels[size] = level_sums(self._features(words, c.window), most if size == SHINGLE else 1)
            prints = fingerprints(levels[size], at, count)
            for k, (occurs, values, windows) in enumerate(c.tables):
                value = _block(prints, k)
                hit = np.flatnonzero(occurs[value >> 3] >> (value & 7) & 1)
                first, last = (np.searchsorted(values, value[hit], side) for side in ("left", "right"))
                size_of = last - first
                w = np.repeat(hit, size_of)
                mine = windows[np.repeat(first, size_of) + np.arange(size_of.sum()) - np.repeat(np.cumsum(size_of) - size_of, size_of)]
                near = np.bitwise_count(prints[w] ^ c.prints[mine]) <= RADIUS
                w, mine = w[near], mine[near]
                doc = some[np.searchsorted(firsts, w, "right") - 1]
                found.append(np.stack([doc, c.item[mine], at[w] - doc_starts[doc] - c.offset[mine]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def verified(self, words: np.ndarray, item: int, start: int) -> tuple[float, int, int]:
        """Best similarity near ``start`` in one document's words, with its first word and number of words.

        Of the spans whose ends lie at most the tolerated words off, ties go to the least shift, then to the item's length.
        """
        length, slack = len(self.items[item]), max(1, tolerated(len(self.items[item])))
        firsts = sorted((a for a in range(max(start - slack, 0), start + slack + 1) if a < len(words)), key=lambda a: (abs(a - start), a))
        best = (0.0, 0, 0)
        if length < SHINGLE:
            for a in firsts:
                value = weighted_jaccard(shingle_hashes(words[a : a + length]), self.shingles[item])
                best = max(best, (value, a, len(words[a : a + length])), key=lambda x: x[0])
            return best
        low, high = max(start - slack, 0), min(start + length + slack, len(words))
        if high - low < SHINGLE:
            return best
        shingles, wanted, most, whole = shingle_hashes(words[low:high]), *self.counted[item], len(self.shingles[item])
        kind = np.searchsorted(wanted, shingles)
        kind[kind == len(wanted)] = 0
        known = np.flatnonzero(wanted[kind] == shingles)
        if not len(known):
            return best
        kind = kind[known]
        # The how-manieth of its kind each known shingle is, from the region's first on.
        order = np.argsort(kind, kind="stable")
        new = np.r_[True, kind[order][1:] != kind[order][:-1]]
        nth = np.empty(len(kind), np.int64)
        nth[order] = np.arange(len(kind)) - np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))
        ends = np.arange(SHINGLE, high - low + 1)
        for a in firsts:
            skipped = np.searchsorted(known, a - low)
            before = np.bincount(kind[:skipped], minlength=len(wanted))
            # Each counts as long as the span has no more of its kind than the item.
            counts = (nth[skipped:] - before[kind[skipped:]]) < most[kind[skipped:]]
            both = np.zeros(len(shingles) + 1, np.int64)
            both[known[skipped:] + 1] = counts
            both = np.cumsum(both)[1:]
            b = ends[(ends - (a - low) >= SHINGLE) & (np.abs(ends + low - start - length) <= slack)]
            if not len(b):
                continue
            shared = both[b - SHINGLE]
            value = shared / (b - (a - low) - SHINGLE + 1 + whole - shared)
            k = np.lexsort((np.abs(b - (a - low) - length), -value))[0]
            if value[k] > best[0]:
                best = (float(value[k]), a, int(b[k]) - (a - low))
            if best[0] == 1.0:
                break
        return best


def apart(places: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of spans (similarity, first, count) those that share no word with a better one, or as good and earlier; by place."""
    kept: list[tuple[int, int, float]] = []
    for value, first, count in sorted(set(places), key=lambda p: (-p[0], p[1], p[2])):
        k = bisect.bisect_left(kept, (first,))
        if (k == len(kept) or kept[k][0] >= first + count) and (k == 0 or kept[k - 1][1] <= first):
            kept.insert(k, (first, first + count, value))
    return [(value, first, last - first) for first, last, value in kept]


def _search(index: Index, column: pa.ListArray) -> list[list[tuple[int, float, int, int]]]:
    """For each text's word hashes: (item, similarity, first word, words) of each place of each item found, by item and place."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    out: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(column))]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_WORDS, "right")) - 1)
        words = flat[offsets[at] : offsets[to]]
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        exact: dict[tuple[int, int], int] = {}
        for doc, item, start in index.placements(words, offsets[at:to] - offsets[at], np.diff(offsets[at : to + 1])).tolist():
            # Starts ascend: one inside the last exact passage proposes nothing new.
            if start >= exact.get((doc, item), start):
                got = index.verified(flat[offsets[at + doc] : offsets[at + doc + 1]], item, start)
                if got[0] >= THRESHOLD:
                    found.setdefault((doc, item), []).append(got)
                    if got[0] == 1.0:
                        exact[doc, item] = got[1] + got[2]
        for (doc, item), places in sorted(found.items()):
            out[at + doc] += [(item, *p) for p in apart(places)]
        at = to
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All of ``docs`` with ``matches``: (item, similarity, first_word, n_words) of every place of every benchmark passage in it."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item"), word_hashes(text_or_empty(item_text)).alias("h")).where(F.size("h") > 0)
    n_blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    hashed, matches = fresh(docs, "word_hashes", "matches")
    kind = T.ArrayType(T.StructType([T.StructField("item", items.schema["item"].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))
    out = docs.withColumn(hashed, word_hashes(text_or_empty(text))).withColumn(matches, F.lit(None).cast(kind))
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "h"), F.lit(n_blocks)) == k).sort("item").collect()  # ITEMS_PER_BLOCK or so
        shared = spark.sparkContext.broadcast((Index([np.array(r["h"], np.int64) for r in rows]), [r["item"] for r in rows]))
        out = out.mapInArrow(_matcher(shared, hashed, matches, to_arrow_type(kind)), out.schema)
    return out.withColumn(matches, F.coalesce(matches, F.array().cast(kind))).drop(hashed)


def _matcher(shared, hashed: str, matches: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(matches)
            before = batch.column(at).to_pylist()
            found = _search(index, batch.column(batch.schema.get_field_index(hashed)))
            rows = [(b or []) + [dict(zip(("item", "similarity", "first_word", "n_words"), (names[m[0]], *m[1:]), strict=True)) for m in f] for b, f in zip(before, found, strict=True)]
            columns = [pa.array(rows, kind) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run

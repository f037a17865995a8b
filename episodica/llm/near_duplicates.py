"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text is a weighted set: its five-word shingles with their counts.  Every unit of weight is a region of its own,
into which hashed darts fall as a Poisson process along the rank axis, each with a hashed coordinate; the earliest
dart of a coordinate is its MinHash, and two texts agree in a coordinate with the probability of their weighted
Jaccard similarity.  A text throws only some ``K log K`` darts, however many shingles it has.

1. Texts with equal words are one node, named by the MD5 of their words, whatever the number of copies.
2. Nodes meet in bands of the signature.  Each member of a bucket is first compared with the bucket's hub.
3. Members of a bucket that verified links to hubs leave apart are compared by sketches, all with all, in tiles of two
   blocks of bounded size; a pair is compared in the first band it shares, so in one tile of all.
4. A tile takes its likely pairs in order and links what is still apart.  Links hold by the exact weighted Jaccard
   similarity of the two texts, and their connected components, as rounds of joins with pointer jumping, are the classes.

Defined cases: null counts as empty, and texts without words are one class of equal texts; texts of fewer than five
words have all their words as the one shingle; null or repeated ids stay single rows, since nodes are named by
content; texts of any length are used whole; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, fresh, text_or_empty, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
COORDINATES = BANDS * ROWS
#: Nodes of a bucket in one block; a tile compares two blocks, and the tiles of a bucket cover all its pairs.
BLOCK = 256
#: Estimates from which a pair is verified, three standard deviations below the threshold.
LIKELY = THRESHOLD - 3 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
#: Words that are hashed in one numpy step.
STEP_WORDS = 400_000

_PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each run of ``size`` words of one text, or for all its words if they are fewer."""
    h = hashes.view(np.uint64)
    if not len(h):
        return h
    size = min(size, len(h))
    # Words are hashes already: a sum with odd factors by place, mixed once.
    n = len(h) - size + 1
    out = h[:n] * _PLACES[0]
    for k in range(1, size):
        out += h[k : n + k] * _PLACES[k]
    return _mix(out + np.uint64(size))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of shingle hashes; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    return counted_jaccard((*np.unique(a, return_counts=True), len(a)), (*np.unique(b, return_counts=True), len(b)))


def counted_jaccard(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> float:
    """The same of two multisets as distinct hashes in order, their counts and the sum of these."""
    if not a[2] and not b[2]:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[2] + b[2] - both))


def _batch_shingles(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many texts, text by text, and the text of each."""
    count = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(sizes, SHINGLE)[text]
    h = flat.view(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(SHINGLE):
        use = length > k
        if use.all():
            out = _mix(out * _M1 + h[first + k] + np.uint64(k + 1))
        else:
            out[use] = _mix(out[use] * _M1 + h[first[use] + k] + np.uint64(k + 1))
    return out, text


def dart_signatures(shingles: np.ndarray, text: np.ndarray, n_texts: int, coordinates: int = COORDINATES) -> np.ndarray:
    """``n_texts`` x ``coordinates`` hashes of the earliest darts; texts without shingles get zeros."""
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    # The n-th copy of a shingle in a text is the n-th unit of its weight.
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    cell = _mix(s + _M1 * (copy.astype(np.uint64) + np.uint64(1)))
    weight = np.bincount(t, minlength=n_texts)
    out = np.zeros(n_texts * coordinates, np.uint64)
    best = np.full(n_texts * coordinates, np.inf)
    limit = coordinates * (math.log(coordinates) + 3) / np.maximum(weight, 1)
    open_texts = weight > 0
    while open_texts.any():
        use = open_texts[t]
        _throw(cell[use], t[use], limit, coordinates, best, out)
        open_texts &= np.isinf(best.reshape(n_texts, coordinates)).any(axis=1)
        limit = np.where(open_texts, 2 * limit, limit)
    return out.reshape(n_texts, coordinates)


def _throw(cell: np.ndarray, t: np.ndarray, limit: np.ndarray, coordinates: int, best: np.ndarray, out: np.ndarray) -> None:
    """All darts of these regions with a rank below their text's limit; the earliest of each coordinate stays."""
    ranks, slots, names = [], [], []
    rank, n, top = np.zeros(len(cell)), 0, limit[t]
    while len(cell):
        n += 1
        dart = _mix(cell + np.uint64(int(_M1) * n & (1 << 64) - 1))
        rank = rank - np.log1p((dart >> np.uint64(11)).astype(np.float64) * -(2.0**-53))
        hit = rank < top
        cell, t, top, rank, dart = cell[hit], t[hit], top[hit], rank[hit], dart[hit]
        name = _mix(dart ^ _M3)
        ranks.append(rank)
        slots.append(t * coordinates + (name % np.uint64(coordinates)).astype(np.int64))
        names.append(name)
    r, k, v = np.concatenate(ranks), np.concatenate(slots), np.concatenate(names)
    np.minimum.at(best, k, r)
    first = best[k] == r
    out[k[first]] = v[first]


def content_key(text: Column) -> Column:
    return F.md5(F.array_join(words(F.lower(text)), " "))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, word hashes -> key, band hashes, sketch of a byte for each coordinate."""
    for batch in batches:
        column = batch.column(1)
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_WORDS, "right")) - 1)
            shingles, text = _batch_shingles(flat, offsets[at:to], sizes[at:to])
            signature = dart_signatures(shingles, text, to - at)
            bands = np.zeros((to - at, BANDS), np.uint64)
            for k in range(ROWS):
                bands = _mix(bands * _M1 + signature[:, k::ROWS])
            sketch = (signature & np.uint64(255)).astype(np.uint8).tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (to - at + 1) * BANDS, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
            parts = pa.array([sketch[i : i + COORDINATES] for i in range(0, len(sketch), COORDINATES)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists, parts], names=["key", "bands", "sketch"])
            at = to


def signatures(texts: DataFrame, text: str = "text") -> DataFrame:
    """``key``, ``bands`` and ``sketch`` of each text."""
    clean = words(F.lower(text_or_empty(text)))
    hashed = texts.select(clean.alias("w")).select(F.md5(F.array_join("w", " ")).alias("key"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    return hashed.mapInArrow(_signed, "key string, bands array<long>, sketch binary")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: equal bytes, less those that are equal by chance."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _root(tree: list[int], x: int) -> int:
    while tree[x] != x:
        tree[x] = tree[tree[x]]
        x = tree[x]
    return x


def likely_pairs(sketches: np.ndarray, bands: np.ndarray, trees: np.ndarray, blocks: np.ndarray, hubs: np.ndarray, band: int, one_block: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one tile, likeliest first, and their estimates: of different trees, that meet first in ``band``.

    The bucket's hub has met every other member already, and two members of one block meet in the block's own tile.
    """
    left, right = (np.arange(len(blocks)),) * 2 if one_block else (np.flatnonzero(blocks == blocks[0]), np.flatnonzero(blocks != blocks[0]))
    rows, columns, values = [], [], []
    for i in left:
        j = right[right > i] if one_block else right
        j = j[(trees[j] != trees[i]) & ~hubs[j]] if not hubs[i] else j[:0]
        similar = estimates(sketches[i], sketches[j])
        near = similar >= LIKELY
        j, similar = j[near], similar[near]
        first = np.argmax(bands[i] == bands[j], axis=1) == band
        rows.append(np.full(first.sum(), i))
        columns.append(j[first])
        values.append(similar[first])
    i, j, similar = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns, values))
    order = np.argsort(-similar, kind="stable")
    return i[order], j[order], similar[order]


def tile_links(i: np.ndarray, j: np.ndarray, similar: np.ndarray, trees: list[int], holds) -> list[tuple[int, int]]:
    """Links between different trees, likeliest first, that ``holds`` confirms; only these join trees."""
    tree, out = list(trees), []
    for x, y, s in zip(i.tolist(), j.tolist(), similar.tolist(), strict=True):
        a, b = _root(tree, x), _root(tree, y)
        if a != b:
            if holds(x, y):
                out.append((x, y))
                tree[a] = b
    return out


def _numbered(names: list) -> list[int]:
    """For each name the first place that has it."""
    first: dict = {}
    return [first.setdefault(n, k) for k, n in enumerate(names)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each tile (named by the first column), which come one after another."""
    name, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k) if pa.types.is_list(batch.schema.types[k]) else batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if rows and row[0] != name:
                yield rows
                rows = []
            name = row[0]
            rows.append(row)
    if rows:
        yield rows


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tile, band, whether of one block, block, key, component, hub, sketch, bands -> members of a tile's likely pairs.

    The first row of each tile has its pairs, as places among the tile's rows by key.
    """
    names = ["tile", "place", "key", "component", "pairs"]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], names=names)

    for rows in _tiles(batches):
        tile, band, one_block, blocks, keys, components_, hubs, sketches, bands = zip(*rows, strict=True)
        if len(rows) < 2:
            continue
        flat = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, COORDINATES)
        values = np.concatenate([b.values.to_numpy() for b in bands]).reshape(-1, BANDS)
        i, j, similar = likely_pairs(flat, values, np.array(_numbered(components_)), np.array(blocks), np.array(hubs), band[0], one_block[0])
        if not len(i):
            continue
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        pairs = np.stack([back[: len(i)], back[len(i) :]]).astype(np.uint16).tobytes() + similar.astype(np.float32).tobytes()
        out += [(tile[0], n, keys[k], components_[k], pairs if not n else None) for n, k in enumerate(used.tolist())]
        if len(out) > 4000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tile, place, key, component, pairs, word hashes -> the links that hold, of one tile after the other."""
    for rows in _tiles(batches):
        _, _, keys, names, pairs, bodies = zip(*rows, strict=True)
        n = len(pairs[0]) // 8
        i, j = np.frombuffer(pairs[0], np.uint16, 2 * n).reshape(2, n).astype(np.int64)
        similar = np.frombuffer(pairs[0], np.float32, n, 4 * n)
        held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

        def counted(k: int) -> tuple[np.ndarray, np.ndarray, int]:
            if k not in held:
                s = shingle_hashes(bodies[k].values.to_numpy(zero_copy_only=False))
                held[k] = (*np.unique(s, return_counts=True), len(s))
            return held[k]

        def holds(x: int, y: int) -> bool:
            return counted_jaccard(counted(x), counted(y)) >= THRESHOLD

        links = tile_links(i, j, similar, _numbered(names), holds)
        if links:
            both = [(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in links]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*both, strict=True)], names=["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their sketches -> the pairs whose estimate reaches LIKELY."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
        taken = pa.array(np.flatnonzero(estimates(one, two) >= LIKELY))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken)], names=["a", "b"])


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """A written table of ``band``, ``value``, ``key``, ``n`` of the buckets with two nodes or more, and the ``hub`` of each.

    The hub is the member that meets most others over all bands: an original meets its copies more often than they
    meet each other.
    """
    members = nodes.select("key", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = durable(members.join(sizes, ["band", "value"]), "shared")
    met = shared.groupBy("key").agg(F.sum("n").alias("met"))
    hubs = shared.join(met, "key").groupBy("band", "value").agg(F.max(F.struct("met", "key")).alias("h")).select("band", "value", F.col("h.key").alias("hub"))
    buckets = durable(shared.join(hubs, ["band", "value"]), "buckets")
    forget(shared)
    return buckets


def star_links(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Likely pairs ``a`` < ``b`` of a bucket's member and its hub."""
    pairs = buckets.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    one = pairs.join(nodes.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a")
    both = one.join(nodes.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_likely, "a string, b string")


def tile_rows(nodes: DataFrame, buckets: DataFrame, linked: DataFrame) -> DataFrame:
    """The members of every tile: a bucket's members that stay apart from its hub meet each other and all others.

    ``tile`` names it; a member stands once in each tile that its block is part of.
    """
    component = linked.select(F.col("key").alias("hub"), F.col("component").alias("hub_component"))
    named = buckets.join(linked, "key", "left").join(component, "hub", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.withColumn("apart", F.col("component") != F.coalesce("hub_component", "hub"))
    sizes = named.where("apart").groupBy("band", "value").agg(F.count("*").alias("u"))
    # Blocks 0 to p - 1 hold what is apart, blocks p to p + q - 1 the rest, whose members are linked with each other.
    p, q = F.ceil(F.col("u") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("u")) / BLOCK).cast("int")
    placed = named.join(sizes, ["band", "value"]).select("band", "value", "key", "component", (F.col("key") == F.col("hub")).alias("is_hub"), "apart", p.alias("p"), q.alias("q"))
    draw = F.xxhash64("key", "band")
    block = F.when(F.col("apart"), F.pmod(draw, F.col("p"))).otherwise(F.col("p") + F.pmod(draw, F.greatest("q", F.lit(1)))).cast("int")
    met = F.sequence(F.lit(0), F.when(F.col("apart"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)
    tiles = placed.withColumn("block", block).withColumn("other", F.explode(met))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    bare = tiles.select(F.concat_ws(":", "band", "value", low, high).alias("tile"), "band", (low == high).alias("one"), "block", "key", "component", "is_hub")
    return bare.join(nodes, "key").select("tile", "band", "one", "block", "key", "component", "is_hub", "sketch", "bands")


def tile_pairs_linked(nodes: DataFrame, bodies: DataFrame, buckets: DataFrame, linked: DataFrame) -> DataFrame:
    """Verified links ``a`` < ``b`` that join all that a bucket's hub leaves apart and that is similar."""
    rows = tile_rows(nodes, buckets, linked)
    # Text, so that a tile's rows stay together whatever their number; sorted, so that a task holds one tile at a time.
    near = durable(rows.repartition("tile").sortWithinPartitions("tile", "key").mapInArrow(_compared, "tile string, place int, key string, component string, pairs binary"), "near")
    full = near.join(bodies, "key").select("tile", "place", "key", "component", "pairs", "h")
    out = durable(full.repartition("tile").sortWithinPartitions("tile", "place").mapInArrow(_linked, "a string, b string").distinct(), "rest")
    forget(near)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their word hashes -> the pairs of similarity THRESHOLD or more."""
    for batch in batches:
        keep, values = [], []
        left, right = batch.column(2), batch.column(3)
        for k in range(batch.num_rows):
            s = weighted_jaccard(*(shingle_hashes(x[k].values.to_numpy(zero_copy_only=False)) for x in (left, right)))
            if s >= THRESHOLD:
                keep.append(k)
                values.append(s)
        taken = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(values, pa.float64())], names=["a", "b", "similarity"])


def bodies_of(texts: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """``key`` and word hashes ``h`` of the nodes in ``wanted``."""
    clean = text_or_empty(text)
    keyed = texts.select(content_key(clean).alias("key"), clean.alias("text"))
    one = keyed.join(wanted.select("key").distinct(), "key").groupBy("key").agg(F.min("text").alias("text"))
    return one.select("key", F.transform(words(F.lower(F.col("text"))), lambda w: F.xxhash64(w)).alias("h"))


def verified_links(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``similarity`` of the pairs that hold exactly."""
    one = pairs.join(bodies.select(F.col("key").alias("a"), F.col("h").alias("ha")), "a")
    both = one.join(bodies.select(F.col("key").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")
    return both.mapInArrow(_verified, "a string, b string, similarity double")


def components(links: DataFrame) -> DataFrame:
    """``key``, ``component`` (its smallest key) of every node with a link."""
    both = durable(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("component")), "labels")
    while True:
        named = labels.select(F.col("key").alias("b"), F.col("component").alias("c"))
        heard = both.join(named, "b").groupBy("a").agg(F.min("c").alias("heard")).withColumnRenamed("a", "key")
        lower = labels.join(heard, "key").select("key", "component", F.least("component", "heard").alias("low"))
        jump = labels.select(F.col("key").alias("low"), F.col("component").alias("lower"))
        new = durable(lower.join(jump, "low", "left").select("key", F.coalesce(F.least("low", "lower"), F.col("low")).alias("component"), (F.col("component") != F.coalesce(F.least("low", "lower"), F.col("low"))).alias("moved")), "labels")
        forget(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            forget(both)
            return labels.select("key", "component")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``class_id`` (the smallest id of the class), ``class_key`` (the node with that id) for each node."""
    keyed = docs.select(content_key(text_or_empty(text)).alias("key"), F.col(doc_id).alias("id"))
    copies = keyed.groupBy("key").agg(F.min("id").alias("id"))
    signed = signatures(docs, text).groupBy("key").agg(F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    nodes = durable(signed, "nodes")
    buckets = shared_buckets(nodes)
    bodies = durable(bodies_of(docs, buckets, text), "bodies")
    stars = durable(verified_links(bodies, star_links(nodes, buckets)).select("a", "b"), "stars")
    # What the stars join needs no further comparison; the rest of each bucket is compared in tiles.
    hubs = components(stars)
    rest = tile_pairs_linked(nodes, bodies, buckets, hubs)
    for table in (nodes, buckets, bodies, hubs):
        forget(table)
    linked = components(stars.union(rest))
    for table in (stars, rest):
        forget(table)
    named = copies.join(linked, "key", "left").select("key", "id", F.coalesce("component", "key").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))).alias("first"))
    return named.join(first, "component").select("key", F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key"))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``class_id``, the smallest id of its near-duplicates (a clash gets underscores)."""
    key, name = fresh(docs, "content_key", "class_id")
    found = classes(docs, doc_id, text).select(F.col("key").alias(key), F.col("class_id").alias(name))
    return docs.withColumn(key, content_key(text_or_empty(text))).join(found, key).drop(key)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: of its smallest id, and of its equal rows the smallest in column order."""
    key, row = fresh(docs, "content_key", "row")
    chosen = classes(docs, doc_id, text).where("key = class_key").select(F.col("key").alias(key))
    rows = docs.select(content_key(text_or_empty(text)).alias(key), F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.struct(*[docs[c] for c in docs.columns]).alias("all")).alias(row))
    return rows.join(chosen, key).groupBy(key).agg(F.min(row).alias(row)).select(f"{row}.all.*")

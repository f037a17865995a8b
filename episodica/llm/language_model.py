"""Scores of whole texts by a word unigram and by a causal self-attention model over subword ids, trained in numpy.

The corpus gives counts of all training words, from them the counts of all subwords, and the consecutive windows of every
whole training text.  The network attends over the last one to two segments of
subwords and predicts the class of the next subword; within its class a subword has its share of the corpus counts, so
the product is a proper distribution over the vocabulary.

Texts are dealt into blocks of bounded size by their content.  Each block trains the network from the same start on all
windows of its training texts, in the order of their hashes, and the blocks' parameters are averaged by their windows:
the model is a function of the corpus, however its files are split.  Only of a text with more than ``REPEATS`` copies
are the copies spread over the blocks, by their places in the input.

A block numbers its distinct words, and its texts become these numbers.  The words go by their hash to buckets, where each
word of the corpus is counted and encoded once; with counts and subwords they come back to their blocks, where the texts'
ids are put together, trained on and written.  Scoring reads these ids.  Windows of two segments advance by one: each
subword is scored once, with the segment before it as context, by batched masked attention.

Defined cases: a null text counts as empty and has the end token alone; null ids count by the empty text; repeated
rows count, teach and score as often as they occur; with no training text every count is zero and the network is
untrained; texts of any length are scored whole; only the named columns are read, so clashing names cannot occur.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder, portions
from .common import durable, forget, text_or_empty, utf8_size
from .language_id import remainder

SEGMENT = 32
WIDTH = 16
#: Rows of the input embedding; a subword's id modulo this names its row, and the last row begins a text.
ROWS = 8192
#: Classes: the most frequent subwords have one each, the rest share the others by a hash of the id.
OWN_CLASSES = 96
CLASSES = 128
EPOCHS = 1
BATCH = 64
RATE = 5e-3
#: Text bytes of a block, copies of a text that one block may get, distinct words that a worker remembers, reducers
#: of the parameters' average.
BLOCK_BYTES = 12 << 20
REPEATS = 1000
HELD_WORDS = 200_000
REDUCERS = 16
#: Text bytes of rows that are split into words together, or one row.
SPLIT_BYTES = 16 << 20
#: Windows that a block holds and goes through EPOCHS times before it reads on; subwords that are scored together, or one text.
HELD_WINDOWS = 8192
HELD_SUBWORDS = 100_000
#: Segments that are scored in one numpy step, windows of a batch whose attention stays in a core's cache together.
STEP = 28
PART = 16
#: Places whose logits are in a core's cache together, and few enough for BLAS to multiply them without packing.
PLACES = 448
#: Parameters that a step changes together.
CHUNK = 1 << 15
#: Exponents up to this size need no shift: sums of theirs.
LIMIT = 40.0
LARGEST, SMALLEST = math.exp(LIMIT + 5), math.exp(-LIMIT)

_SHAPES = {"e": (ROWS + 1, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "near": (2 * SEGMENT,), "u": (WIDTH, CLASSES), "c": (CLASSES,)}


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A to Z in lower case, which is what bytes.lower and bytes.split do."""
    return (text or "").encode().lower().split()


def start_parameters(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {n: rng.normal(0, 0.2 if n == "e" else 1 / math.sqrt(WIDTH), s).astype(np.float32) for n, s in _SHAPES.items()}
    out["near"][:] = 0
    out["o"] *= 0.3
    out["u"] *= 0.3
    return out


def pack(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[n].ravel() for n in _SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {n: part.copy() for n, part in _views(flat).items()}


def _views(flat: np.ndarray, n_rows: int = ROWS + 1) -> dict[str, np.ndarray]:
    """The parameters, with so many rows of the input embedding, as parts of ``flat``."""
    shapes = _SHAPES | {"e": (n_rows, WIDTH)}
    ends = np.cumsum([math.prod(s) for s in shapes.values()])[:-1]
    return {n: part.reshape(s) for (n, s), part in zip(shapes.items(), np.split(flat, ends), strict=True)}


def _exponentials(h: np.ndarray, u: np.ndarray, z: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Those of ``h @ u`` in ``z``, and their sums by ``often``; shifted row by row if the sums show that they have to be."""
    np.exp(np.matmul(h, u, out=z), out=z)
    totals = z @ often
    if not _fits(totals):
        np.matmul(h, u, out=z)
        z -= (z + np.log(often)).max(axis=1, keepdims=True)
        totals = np.exp(z, out=z) @ often
    return totals


def _often(c: np.ndarray) -> np.ndarray:
    """What classes' exponentials are multiplied by for their own numbers, of which those far below the largest count for nothing."""
    return np.exp(np.maximum(c - c.max(), np.float32(-LIMIT)))


def _softmax(z: np.ndarray) -> np.ndarray:
    """In the place of ``z``."""
    z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def _fits(totals: np.ndarray) -> bool:
    """Whether sums of exponentials show that none of these was too large, nor all of a sum's too small (nan: no)."""
    return bool(np.maximum.reduce(totals) <= LARGEST and np.minimum.reduce(totals) >= SMALLEST)


@np.errstate(over="ignore", invalid="ignore")
def train(p: dict[str, np.ndarray], rows: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
    """Adam on windows of two segments: input rows and target classes, -1 where there is none.

    Queries meet keys, and values the output, in one matrix each (``q k'`` and ``v o``).  What a softmax divides by is
    taken where there are WIDTH values; exponents are shifted only where the sums show that they have to be.  What has
    WIDTH values a place is computed for a batch at once, attention by PART windows and logits by PLACES.
    """
    size, w = 2 * SEGMENT, WIDTH
    distance = np.arange(size)[:, None] - np.arange(size)[None, :]
    past, back = distance >= 0, np.where(distance < 0, size, distance).ravel()
    # Rows of the embedding that these windows don't have keep their values: the others are numbered and packed without them.
    all_rows = p["e"].copy()
    met = np.zeros(len(all_rows), bool)
    met[rows] = True
    rows, met = (np.cumsum(met) - 1).astype(np.int16).take(rows), np.flatnonzero(met)
    flat = pack(p | {"e": all_rows.take(met, axis=0)})
    mean, square, spare = np.zeros_like(flat), np.zeros_like(flat), np.empty(CHUNK, np.float32)
    (p, means, squares), diagonals = (_views(m, len(met)) for m in (flat, mean, square)), np.zeros(size + size * size, np.float32)
    chunks = [(flat[at : at + CHUNK], mean[at : at + CHUNK], square[at : at + CHUNK], spare[: len(flat) - at]) for at in range(0, len(flat), CHUNK)]
    # Working space; d has a further column and xt a further row of ones.
    spaces = [np.empty((BATCH * size, w), np.float32) for _ in range(8)]
    all_xt, all_a, all_d, all_over = np.ones((BATCH, w + 1, size), np.float32), np.empty((BATCH, size, size), np.float32), np.empty((BATCH * size, w + 1), np.float32), np.empty(BATCH * size, np.float32)
    all_ds, all_z, all_by = np.empty((PART, size, size), np.float32), np.empty((PLACES, CLASSES), np.float32), np.empty((PART, size, w), np.float32)
    starts, ones, scale, step = np.arange(PLACES) * CLASSES, np.ones(size, np.float32), np.float32(1 / math.sqrt(w)), 0
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            take = order[at : at + BATCH]
            n, r, y = len(take), rows.take(take, axis=0).ravel(), targets.take(take, axis=0).ravel()
            # The mean over the batch's targets.
            live = (y >= 0).astype(np.float32)
            live /= max(1.0, float(live.sum()))
            y = np.maximum(y, 0)
            qk, vo, u = p["q"] @ p["k"].T * scale, p["v"] @ p["o"], p["u"]
            # Classes count by the exponential of their own number, which their logits leave out.
            often = _often(p["c"])
            qkt, vot, ut, seldom = np.ascontiguousarray(qk.T), np.ascontiguousarray(vo.T), np.ascontiguousarray((u * often).T), 1 / often
            weight = np.append(np.exp(p["near"] - p["near"].max()), np.float32(0)).take(back)
            du, dc, dvo, dqk, dnear = (np.zeros(g, np.float32) for g in (u.shape, CLASSES, vo.shape, qk.shape, size * size))
            x, xq, o, h, dh, do, dxq, dx = (m[: n * size] for m in spaces)
            cubes, queries, os, dos, dxqs, dxs = (m.reshape(n, size, w) for m in (x, xq, o, do, dxq, dx))
            xt, a, d, over = all_xt[:n], all_a[:n], all_d[: n * size], all_over[: n * size]
            p["e"].take(r, axis=0, out=x, mode="clip")
            xt[:, :w] = cubes.transpose(0, 2, 1)
            for lo in range(0, n, PART):
                here, hi = slice(lo, lo + PART), min(lo + PART, n)
                flat_here = slice(lo * size, hi * size)
                part, totals = a[here], over[flat_here]
                np.matmul(x[flat_here], qk, out=xq[flat_here])
                pairs = part.reshape(hi - lo, -1)
                np.exp(np.matmul(queries[here], xt[here, :w], out=part), out=part)
                pairs *= weight
                np.matmul(part.reshape(-1, size), ones, out=totals)
                if not _fits(totals):
                    np.matmul(queries[here], xt[here, :w], out=part)
                    part -= np.where(past, part, -np.inf).max(axis=2, keepdims=True)
                    np.exp(np.minimum(part, 0, out=part), out=part)
                    pairs *= weight
                    np.matmul(part.reshape(-1, size), ones, out=totals)
                np.matmul(part, cubes[here], out=os[here])
                np.divide(1, totals, out=totals)
                o[flat_here] *= totals[:, None]
                np.matmul(o[flat_here], vo, out=h[flat_here])
            h += x
            for lo in range(0, n * size, PLACES):
                here = slice(lo, lo + PLACES)
                deep = h[here]
                k = len(deep)
                z, flat_z, classes = all_z[:k], all_z[:k].reshape(-1), y[here]
                total = _exponentials(deep, u, z, often)
                chosen = starts[:k] + classes
                flat_z[chosen] = flat_z.take(chosen) - total * seldom.take(classes)
                share = live[here] / total
                np.matmul(z, ut, out=dh[here])
                dh[here] *= share[:, None]
                deep *= share[:, None]
                du += deep.T @ z
                dc += share @ z
                np.matmul(dh[here], vot, out=do[here])
            do *= over[:, None]
            d[:, :w] = do
            # The sum of a row of a times its gradient is that of the output times its own.
            np.matmul(np.multiply(do, o, out=h), -ones[:w], out=over)
            d[:, w] = over
            for lo in range(0, n, PART):
                here, b = slice(lo, lo + PART), min(PART, n - lo)
                flat_here = slice(lo * size, (lo + b) * size)
                ds, by, part = all_ds[:b], all_by[:b], a[here]
                np.matmul(d.reshape(n, size, -1)[here], xt[here], out=ds)
                ds *= part
                np.matmul(ds, cubes[here], out=dxqs[here])
                np.matmul(ds.transpose(0, 2, 1), queries[here], out=dxs[here])
                dxs[here] += np.matmul(part.transpose(0, 2, 1), dos[here], out=by)
                dx[flat_here] += np.matmul(dxq[flat_here], qkt, out=by.reshape(-1, w))
                dnear += ones[:b] @ ds.reshape(b, -1)
                dvo += o[flat_here].T @ dh[flat_here]
                dqk += x[flat_here].T @ dxq[flat_here]
            dx += dh
            # Row i and column i - d have distance d; where that column is before the first, there are zeros.
            diagonals[size:] = dnear
            near = np.ndarray((size, size), np.float32, diagonals, 4 * size, (4 * (size + 1), -4)).sum(axis=0)
            by_row = np.argsort(r, kind="stable")
            r = r.take(by_row)
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            r, de = r.take(first), np.add.reduceat(dx.take(by_row, axis=0, out=h, mode="clip"), first, axis=0)
            dqk *= scale
            step += 1
            root = math.sqrt(1 - 0.99**step)
            # Ten times the mean of slopes and a hundred times that of their squares, which are zero for rows not met.
            means["e"][r] += de
            squares["e"][r] += de * de
            for name, g in {"q": dqk @ p["k"], "k": dqk.T @ p["q"], "v": dvo @ p["o"].T, "o": p["v"].T @ dvo, "near": near, "u": du * often, "c": dc * often}.items():
                means[name] += g
                squares[name] += g * g
            small, rate = np.float32(1e-7 * root), np.float32(RATE * root / (1 - 0.9**step))
            for value, m, s, by in chunks:
                np.sqrt(s, out=by)
                by += small
                np.divide(m, by, out=by)
                by *= rate
                value -= by
                m *= np.float32(0.9)
                s *= np.float32(0.99)
    all_rows[met] = p["e"]
    return p | {"e": all_rows}


def windows(ids: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input rows and target classes of one text's consecutive windows of two segments; each subword is a target once."""
    size = 2 * SEGMENT
    n = -(-len(ids) // size)
    rows, targets = np.full(n * size, ROWS, np.int16), np.full(n * size, -1, np.int16)
    rows[1 : len(ids)] = ids[:-1] % ROWS
    targets[: len(ids)] = classes.take(ids)
    return rows.reshape(n, size), targets.reshape(n, size)


class Scorer:
    """log10 probabilities of subword sequences."""

    def __init__(self, parameters: dict[str, np.ndarray], classes: np.ndarray, log_share: np.ndarray):
        p = parameters
        # Classes count by the exponential of their own number, which their logits leave out.
        self.u, self.often = p["u"], _often(p["c"])
        self.classes, self.log_share = classes.astype(np.intp), log_share + (p["c"] - p["c"].max()).astype(float)[classes] / math.log(10)
        # One layer deep, queries and values depend on the input row alone.
        self.table = np.concatenate([p["e"], p["e"] @ (p["v"] @ p["o"]), p["e"] @ (p["q"] @ p["k"].T * np.float32(1 / math.sqrt(WIDTH)))], axis=1)
        # Keys by queries.
        i, j = np.arange(SEGMENT)[None, :] + SEGMENT, np.arange(2 * SEGMENT)[:, None]
        self.past = j <= i
        self.near = np.where(self.past, np.exp(p["near"][np.clip(i - j, 0, 2 * SEGMENT - 1)] - p["near"].max()), np.float32(0)).ravel()

    @np.errstate(over="ignore", invalid="ignore")
    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each sequence of ids."""
        sizes = np.array([len(t) for t in texts], np.int64)
        segments = -(-sizes // SEGMENT)
        start = (np.cumsum(segments) - segments) * SEGMENT
        place = np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        total = int(segments.sum()) * SEGMENT
        ids = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
        # The rows have one segment before the first.
        classes, rows = np.zeros(total, np.intp), np.full(SEGMENT + total + 1, ROWS, np.int16)
        classes[place] = self.classes.take(ids)
        rows[SEGMENT + 1 + place] = ids % ROWS
        rows[SEGMENT + start] = ROWS
        begins = np.zeros(total // SEGMENT, bool)
        begins[start[segments > 0] // SEGMENT] = True
        got, sums = np.empty(total, np.float32), np.empty(total, np.float32)
        n = min(STEP, len(begins))
        all_a, all_q, all_h, all_z = (np.empty(s, np.float32) for s in ((n, 2 * SEGMENT, SEGMENT), (n, WIDTH, SEGMENT), (n, SEGMENT, WIDTH), (min(n * SEGMENT, PLACES), CLASSES)))
        ones, starts = np.ones(2 * SEGMENT, np.float32), np.arange(len(all_z)) * CLASSES
        for at in range(0, len(begins), STEP):
            to = min(at + STEP, len(begins))
            b, a, q, h, first = to - at, all_a[: to - at], all_q[: to - at], all_h[: to - at], begins[at:to]
            held = self.table.take(rows[at * SEGMENT : (to + 1) * SEGMENT], axis=0)
            x, queries = held[SEGMENT:, :WIDTH].reshape(b, SEGMENT, WIDTH), held[SEGMENT:, 2 * WIDTH :].reshape(b, SEGMENT, WIDTH)
            # Of each segment, the keys and values of the segment before and its own.
            keys, values = (np.ndarray((b, 2 * SEGMENT, WIDTH), held.dtype, held, at * held.itemsize, (SEGMENT * held.strides[0], *held.strides)) for at in (0, WIDTH))
            q[:] = queries.transpose(0, 2, 1)
            np.exp(np.matmul(keys, q, out=a), out=a)
            np.multiply(a.reshape(b, -1), self.near, out=a.reshape(b, -1))
            a[first, :SEGMENT] = 0
            over = ones @ a
            if not _fits(over.ravel()):
                np.matmul(keys, q, out=a)
                seen = np.where(self.past, a, -np.inf)
                seen[first, :SEGMENT] = -np.inf
                a -= seen.max(axis=1, keepdims=True)
                np.exp(np.minimum(a, 0, out=a), out=a)
                np.multiply(a.reshape(b, -1), self.near, out=a.reshape(b, -1))
                a[first, :SEGMENT] = 0
                over = ones @ a
            np.matmul(a.transpose(0, 2, 1), values, out=h)
            h /= over[:, :, None]
            h += x
            for lo in range(0, b * SEGMENT, PLACES):
                deep = h.reshape(-1, WIDTH)[lo : lo + PLACES]
                here, z = slice(at * SEGMENT + lo, at * SEGMENT + lo + len(deep)), all_z[: len(deep)]
                chosen = starts[: len(deep)] + classes[here]
                np.matmul(deep, self.u, out=z)
                z.reshape(-1).take(chosen, out=got[here], mode="clip")
                np.matmul(np.exp(z, out=z), self.often, out=sums[here])
                if not _fits(sums[here]):
                    np.matmul(deep, self.u, out=z)
                    z -= (z + np.log(self.often)).max(axis=1, keepdims=True)
                    z.reshape(-1).take(chosen, out=got[here], mode="clip")
                    np.matmul(np.exp(z, out=z), self.often, out=sums[here])
        got -= np.log(sums, out=sums)
        got *= np.float32(1 / math.log(10))
        return np.bincount(np.repeat(np.arange(len(texts)), sizes), got.take(place) + self.log_share.take(ids), len(texts))


def _pieces(path: str):
    """Word -> its subword ids as bytes, by the worker's coder."""
    own = coder(path)

    def of(word: bytes) -> bytes:
        if len(own.cache) > HELD_WORDS:
            own.cache.clear()
        return own.ids_of(own.normalized(word.decode("utf-8", "replace")))

    return of


_ZSTD = pa.Codec("zstd", 1)


def _packed(values: np.ndarray | bytes) -> bytes:
    """Compressed, behind the number of bytes: what is dealt out and written shrinks to a half or less."""
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(held: bytes) -> bytes:
    return _ZSTD.decompress(memoryview(held)[8:], int.from_bytes(held[:8], "little"), asbytes=True)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What :func:`tokens_of` gives of each text, one text after the other, and how many words each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    # There are empty strings beside white space at the ends.
    full = pc.not_equal(pc.binary_length(words), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
        words = words.filter(full)
    return words.dictionary_encode(), lengths


def strings(values: pa.Array) -> list[str]:
    """Many times faster than ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


class _Index(dict):
    """The place of each word, in the order in which they are first asked for."""

    def __missing__(self, word: str | bytes) -> int:
        place = self[word] = len(self)
        return place


def indexed(blocked: DataFrame, n_buckets: int) -> DataFrame:
    """Texts as numbers of words, and each block's words by ``bucket``: ``block``, ``doc_id``, ``held_out``, ``text``, block by block.

    A text's row has its ``place`` in the block and ``own``, the numbers of its words there.  The other rows have a
    ``bucket`` of the block's distinct words, their numbers and how often each occurs in training texts.
    """
    kind = dict(blocked.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index, place, counts = None, None, 0, np.zeros(0, np.int64)

        def batch_of(block: list, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"block": pa.int32(), "place": pa.int32(), "bucket": pa.int32(), "doc_id": doc_type, "held_out": pa.bool_(), "own": pa.binary(), "words": pa.binary(), "n": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *[columns.get(c, pa.nulls(len(block), k)) for c, k in kinds.items() if c != "block"]], names=list(kinds))

        def vocabulary() -> Iterator[pa.RecordBatch]:
            words = list(index)
            # A word meets its forms with other marks at the end, which share their encoding's start.
            buckets = np.fromiter([zlib.crc32(w.rstrip(".,;:!?").encode()) for w in words], np.int64, len(words)) % n_buckets
            order = np.argsort(buckets, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1) if words else ():
                columns = {"own": _packed(at.astype(np.uint32)), "words": _packed(" ".join([words[i] for i in at.tolist()]).encode()), "n": _packed(counts[at])}
                yield batch_of([name], bucket=pa.array([buckets[at[0]]], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in columns.items()})

        # Splitting holds several times a batch's texts: it gets a few megabytes at a time.
        for batch in (part for whole in batches for part in portions(whole, 3, SPLIT_BYTES)):
            doc_type, blocks = batch.column(1).type, batch.column(0).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
                if lo == hi:
                    continue
                if blocks[lo] != name:
                    if name is not None:
                        yield from vocabulary()
                    name, index, place, counts = int(blocks[lo]), None, 0, np.zeros(0, np.int64)
                part = batch.slice(lo, hi - lo)
                texts, n = part.column(3), hi - lo
                # Copies of a text follow each other and are split once.
                new = np.append(True, pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False))
                words, lengths = words_of(texts.filter(pa.array(new)))
                numbers, known = words.indices.to_numpy().astype(np.uint32), strings(words.dictionary)
                if index is None:  # a block's first texts, and mostly all: their words are in the order of their numbers
                    index = known
                else:
                    index = index if isinstance(index, _Index) else _Index(zip(index, range(len(index)), strict=True))
                    numbers = np.fromiter(map(index.__getitem__, known), np.uint32, len(known))[numbers]
                which = np.cumsum(new) - 1
                times = np.bincount(which[~part.column(2).to_numpy(zero_copy_only=False)], minlength=len(lengths))
                more = np.bincount(numbers, np.repeat(times, lengths), len(index)).astype(np.int64)
                more[: len(counts)] += counts
                counts = more
                packed = [_packed(numbers[i:j]) for i, j in pairwise([0, *np.cumsum(lengths).tolist()])]
                places = pa.array(np.arange(place, place + n, dtype=np.int32))
                place += n
                out = batch_of([name] * n, place=places, doc_id=part.column(1), held_out=part.column(2), own=pa.array([packed[i] for i in which.tolist()], pa.binary()))
                del words, known, numbers, packed
                pa.default_memory_pool().release_unused()  # what splitting took is many times the texts' size
                yield out
        if name is not None:
            yield from vocabulary()

    return blocked.mapInArrow(run, f"block int, place int, bucket int, doc_id {kind}, held_out boolean, own binary, words binary, n binary")


def unified(vocabulary: DataFrame, path: str) -> DataFrame:
    """What all blocks together know of each block's words, bucket by bucket: ``bucket``, ``block``, ``own``, ``words``, ``n``.

    Each word of the corpus is counted and encoded once.  A block's row has the counts of its words, the lengths of
    their encodings and these.  A row without block has a bucket's distinct training words, and its subwords' counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name, held = coder(path), None, []

        def done() -> Iterator[pa.RecordBatch]:
            words, sizes = words_of(pa.array([_unpacked(words) for _, _, words, _ in held], pa.binary()).cast(pa.string()))
            at = np.split(words.indices.to_numpy(), np.cumsum(sizes)[:-1])
            words = strings(words.dictionary)
            totals = np.zeros(len(words), np.int64)
            for numbers, (_, _, _, n) in zip(at, held, strict=True):
                totals[numbers] += np.frombuffer(_unpacked(n), np.int64)
            pieces = []
            for i in range(0, len(words), 1 << 16):
                pieces += own.ids_of_all([own.normalized(w) for w in words[i : i + (1 << 16)]])
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            ids, start = np.frombuffer(b"".join(pieces), np.uint32), np.cumsum(lengths) - lengths
            for numbers, (block, local, _, _) in zip(at, held, strict=True):
                yield row(block, local, totals[numbers], lengths[numbers], _runs(ids, start[numbers], lengths[numbers]))
            counts = np.bincount(ids, np.repeat(totals, lengths)).astype(np.int64)
            different = np.flatnonzero(counts).astype(np.uint32)
            yield row(None, None, counts[different], None, different, int(totals.sum()), int(np.count_nonzero(totals)))

        def row(block: int | None, local: bytes | None, n: np.ndarray, lengths: np.ndarray | None, ids: np.ndarray, all_n: int | None = None, v: int | None = None) -> pa.RecordBatch:
            parts = [local, _packed(n), None if lengths is None else _packed(lengths.astype(np.uint32)), _packed(ids)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([x], pa.binary()) for x in parts], pa.array([all_n], pa.int64()), pa.array([v], pa.int64())], names=["block", "own", "n", "lengths", "ids", "all_n", "v"])

        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != name and held:
                    yield from done()
                    held.clear()
                name = bucket
                held.append(rest)
        if held:
            yield from done()

    return vocabulary.mapInArrow(run, "block int, own binary, n binary, lengths binary, ids binary, all_n long, v long")


def _runs(values: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` for each start and length, one after the other."""
    return values[np.arange(lengths.sum()) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)]


def subword_counts(statistics: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Of the rows without block of :func:`unified`: each subword's count, all words' count and how many different ones there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, different = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for ids, n, all_n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[np.frombuffer(_unpacked(ids), np.uint32)] += np.frombuffer(_unpacked(n), np.int64)
                words, different = words + all_n, different + v
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary()), pa.array([words], pa.int64()), pa.array([different], pa.int64())], names=["n", "all_n", "v"])

    parts = statistics.select("ids", "n", "all_n", "v").repartition(REDUCERS).mapInArrow(add, "n binary, all_n long, v long").collect()
    return sum((np.frombuffer(_unpacked(r["n"]), np.int64) for r in parts), np.zeros(size, np.int64)), sum(r["all_n"] for r in parts), sum(r["v"] for r in parts)


def vocabulary_classes(size: int, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class of each subword and log10 of its share within the class."""
    n = np.full(size, 0.5)
    for i, c in counts.items():
        n[i] += c
    classes = OWN_CLASSES + (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (CLASSES - OWN_CLASSES)
    frequent = np.lexsort((np.arange(size), -n))[:OWN_CLASSES]
    classes[frequent] = np.arange(len(frequent))
    return classes, np.log10(n / np.bincount(classes, n, CLASSES)[classes])


class _Learner:
    """Trains one block's network after the other and sums what they learned by their windows."""

    def __init__(self, classes: np.ndarray):
        self.classes, self.block, self.sum, self.all = classes.astype(np.int16), None, None, 0
        self.p, self.n, self.held, self.rows, self.targets = start_parameters(), 0, 0, [], []

    def read(self, block: int, ids: np.ndarray) -> None:
        """The next text of a block; the network goes on from where the block's windows before have left it."""
        if block != self.block:
            self.end_block()
            self.block = block
        row, target = windows(ids, self.classes)
        self.rows.append(row)
        self.targets.append(target)
        self.held += len(row)
        if self.held >= HELD_WINDOWS:
            self._learn()

    def _learn(self) -> None:
        if self.held:
            self.p = train(self.p, np.concatenate(self.rows), np.concatenate(self.targets))
            self.n, self.held, self.rows, self.targets = self.n + self.held, 0, [], []

    def end_block(self) -> None:
        self._learn()
        if self.n:
            part = pack(self.p) * np.float32(self.n)
            self.sum = part if self.sum is None else self.sum + part
            self.all += self.n
            self.p, self.n = start_parameters(), 0


def _average(parts: DataFrame) -> dict[str, np.ndarray]:
    """Of ``p``, sums of networks by their windows, and ``windows``, how many these are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(p, np.float32)
                total, n = part if total is None else total + part, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["p", "windows"])

    sums = parts.select("p", "windows").repartition(REDUCERS).mapInArrow(add, "p binary, windows long").collect()
    if not sums:
        return start_parameters()
    return unpack(sum(np.frombuffer(r["p"], np.float32) for r in sums) / np.float32(sum(r["windows"] for r in sums)))


def train_distributed(blocked: DataFrame, path: str, classes: np.ndarray, end: int) -> dict[str, np.ndarray]:
    """The average by windows of the networks of the blocks: ``block`` and ``text`` of training rows, block by block."""
    shared = blocked.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, learner = _pieces(path), _Learner(shared.value)
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                learner.read(block, np.append(np.frombuffer(b"".join([of(w) for w in tokens_of(text)]), np.uint32), np.uint32(end)))
        learner.end_block()
        if learner.all:
            yield pa.RecordBatch.from_arrays([pa.array([learner.sum.tobytes()], pa.binary()), pa.array([learner.all], pa.int64())], names=["p", "windows"])

    return _average(blocked.mapInArrow(run, "p binary, windows long"))


def encoded(blocked: DataFrame, classes: np.ndarray, end: int, network: bool = True) -> DataFrame:
    """Every text's ids and word counts, and the networks trained on the way: the rows of each block's words, then its texts by place.

    A text's row has ``n_words``, ``n_known``, ``logs`` (the sum of log10 of its words' counts and a half) and ``ids``;
    a row without these has the sum of a task's networks by their windows.  Without ``network`` nothing is trained and
    there are no ids.
    """
    shared = blocked.sparkSession.sparkContext.broadcast(classes)
    kind = dict(blocked.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, name, words, joint, small = _Learner(shared.value), None, [], None, np.uint16 if len(shared.value) <= 1 << 16 else np.uint32

        def joined() -> tuple[np.ndarray, ...]:
            """By number of a word, and last for a text's end: whether it is known, log10 of its count and a half (of the end 0), where its ids start and how many they are; all ids."""
            own, n, lengths, ids = (np.concatenate([np.zeros(0, t), *[np.frombuffer(_unpacked(w[k]), t) for w in words]]) for k, t in enumerate((np.uint32, np.int64, np.uint32, np.uint32)))
            back = np.empty(len(own), np.int64)
            back[own] = np.arange(len(own))
            lengths = lengths.astype(np.int64)
            start = np.cumsum(lengths) - lengths
            different, which = np.unique(n, return_inverse=True)
            logs = np.array([math.log10(c + 0.5) for c in different.tolist()], np.longdouble)[which]
            return np.append(n[back] > 0, False), np.append(logs[back], np.longdouble(0)), np.append(start[back], len(ids)), np.append(lengths[back], 1), np.append(ids, np.uint32(end)).astype(small)

        def done(block: int | None, texts: list[np.ndarray], rows: list[tuple[int, bool]], out: dict[str, list]) -> None:
            """Puts into ``out`` what ``rows`` of ``texts`` by their place there and held out or not have."""
            if not rows:
                return
            known, logs, start, lengths, pieces = joint
            numbers = np.concatenate([part for text in texts for part in (text, np.array([len(known) - 1], np.uint32))])
            sizes = np.array([len(t) + 1 for t in texts])
            first = np.cumsum(sizes) - sizes
            values = [(sizes - 1).tolist(), np.add.reduceat(known.take(numbers), first, dtype=np.int64).tolist(), np.add.reduceat(logs.take(numbers), first).astype(float).tolist(), [None] * len(texts)]
            if network:
                many = lengths.take(numbers)
                ids = np.split(_runs(pieces, start.take(numbers), many), np.cumsum(np.add.reduceat(many, first))[:-1])
                values[3] = [_packed(t) for t in ids]
                for which, held_out in rows:
                    if not held_out:
                        learner.read(block, ids[which])
            for c, x in zip(out.values(), values, strict=True):
                c += [x[which] for which, _ in rows]

        for batch in batches:
            blocks, places, docs, held, *parts = (c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns))
            at, out, texts, rows, before, waiting = [], {"n_words": [], "n_known": [], "logs": [], "ids": []}, [], [], None, 0
            for i, (block, place, held_out, own, *rest) in enumerate(zip(blocks, places, held, *parts, strict=True)):
                if block != name or waiting > HELD_SUBWORDS:
                    done(name, texts, rows, out)
                    texts, rows, before, waiting = [], [], None, 0
                if block != name:
                    name, words, joint = block, [], None
                if place < 0:
                    words.append((own, *rest))
                    continue
                if joint is None:
                    joint, words = joined(), []
                if own != before:
                    before = own
                    texts.append(np.frombuffer(_unpacked(own), np.uint32))
                    waiting += len(texts[-1]) + 1
                rows.append((len(texts) - 1, held_out))
                at.append(i)
            done(name, texts, rows, out)
            n = len(at)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([
                docs.take(taken), batch.column(3).take(taken), pa.array(out["n_words"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["logs"], pa.float64()),
                pa.array(out["ids"], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
            ], names=names)
            doc_type = docs.type
        learner.end_block()
        if learner.all:
            empty = [pa.nulls(1, t) for t in (doc_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([learner.sum.tobytes()], pa.binary()), pa.array([learner.all], pa.int64())], names=names)

    names = ["doc_id", "held_out", "n_words", "n_known", "logs", "ids", "p", "windows"]
    return blocked.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_words long, n_known long, logs double, ids binary, p binary, windows long")


def groups(named: DataFrame) -> DataFrame:
    """Of each text's hash ``repeated``: its rows ``n``, further columns as sums of ``bytes`` and ``ends``."""
    sums = [F.sum(c).alias(c) for c in ("bytes", "ends") if c in named.columns]
    return named.groupBy(F.xxhash64("text").alias("repeated")).agg(F.count("*").alias("n"), *sums)


def dealt(named: DataFrame, n_blocks: int, counted: DataFrame | None = None) -> DataFrame:
    """``named`` with ``block``, by the text's hash ``h``, which stays; ``counted`` has its :func:`groups`."""
    hashed = named.withColumn("h", F.xxhash64("text"))
    counts = (groups(named) if counted is None else counted).where(F.col("n") > REPEATS)
    # At most one row for REPEATS rows, joined by broadcast only while its file is small.
    salted = hashed.withColumn("place", F.monotonically_increasing_id()).join(durable(counts.select("repeated"), "repeated"), F.col("h") == F.col("repeated"), "left")
    salt = F.when(F.col("repeated").isNotNull(), F.col("place")).otherwise(0)
    return salted.withColumn("block", F.pmod(F.xxhash64("h", salt), F.lit(n_blocks)).cast("int")).drop("repeated", "place")


def score(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", by: int = 5, held: int = 1, network: bool = True) -> DataFrame:
    """``doc_id``, ``held_out``, token counts, ``base_score`` and the network's ``score`` of every row.

    Without ``network`` the same steps count the same words, but nothing is trained and there is no ``score``.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("held_out", remainder("doc_id", by) == held)
    counted = durable(groups(named.select("text", (utf8_size(F.col("text")) + 64).alias("bytes"), (~F.col("held_out")).cast("long").alias("ends"))), "groups")
    sizes = counted.agg(F.sum("bytes").alias("bytes"), F.sum("ends").alias("ends")).first()
    ends, n_blocks = sizes["ends"] or 0, max(1, -(-(sizes["bytes"] or 0) // BLOCK_BYTES))
    own = coder(path)
    end, size = own.vocabulary["<|endoftext|>"], max(own.tokens) + 1

    blocks = dealt(named, n_blocks, counted).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "h", "text")
    read = durable(indexed(blocks.select("block", "doc_id", "held_out", "text"), n_blocks), "indexed")
    buckets = read.where("bucket is not null").select("bucket", "block", "own", "words", "n")
    known = durable(unified(buckets.repartitionById(n_blocks, F.col("bucket")).sortWithinPartitions("bucket"), path), "words")
    subwords, n, v = subword_counts(known.where("block is null"), size)
    subwords[end] += ends
    n, v = n + ends, v + (ends > 0)
    classes, log_share = vocabulary_classes(size, dict(enumerate(subwords.tolist())))
    binary = [F.lit(None).cast("binary").alias(c) for c in ("n", "lengths", "ids")]
    texts = read.where("bucket is null").select("block", "place", "doc_id", "held_out", "own", *binary)
    words = known.where("block is not null").select("block", F.lit(-1).alias("place"), F.lit(None).cast(texts.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), "own", "n", "lengths", "ids")
    done = durable(encoded(texts.unionAll(words).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "place"), classes, end, network), "encoded")
    for table in (counted, read, known):
        forget(table)
    base = math.log10(n + 0.5 * (v + 1))
    last = math.log10(ends + 0.5)
    if not network:
        n_tokens = F.col("n_words") + 1
        counts = [n_tokens.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens")]
        return done.select("doc_id", "held_out", *counts, (F.col("logs") + F.lit(last) - n_tokens * F.lit(base)).alias("base_score"))
    parameters = _average(done.where("p is not null"))
    shared = docs.sparkSession.sparkContext.broadcast((parameters, classes, log_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        small = np.uint16 if size <= 1 << 16 else np.uint32
        for batch in batches:
            # Copies of a text that meet here are scored once.
            places, scores, sequences, size_of_all = _Index(), [], [], 0
            which = [*map(places.__getitem__, batch.column("ids").to_pylist())]
            for ids in places:
                sequences.append(np.frombuffer(_unpacked(ids), small))
                size_of_all += len(sequences[-1])
                if size_of_all > HELD_SUBWORDS:
                    scores.append(scorer.score(sequences))
                    sequences, size_of_all = [], 0
            scores.append(scorer.score(sequences))
            n_tokens = batch.column("n_words").to_numpy() + 1
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens), pa.array(batch.column("n_known").to_numpy() + (ends > 0)), pa.array(np.full(len(which), n, np.int64)),
                pa.array(batch.column("logs").to_numpy() + last - n_tokens * base), pa.array(np.concatenate(scores)[which]),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(done.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return done.where("p is null").select("doc_id", "held_out", "n_words", "n_known", "logs", "ids").mapInArrow(run, schema)

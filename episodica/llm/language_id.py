"""Language identification by a byte convolutional network trained and run in numpy.

Filters of several widths slide over the bytes of a fixed-length window; each filter's maximum over the window feeds
a softmax over the languages.  The network is fitted on a bounded sample of labelled windows (``WINDOWS_PER_LANGUAGE``),
in which every window of every whole text has the same chance, and applied to every window of every whole text, in batches; a text's distribution is
the mean of its windows', weighted by their bytes.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null labels are not learned from; with
no labelled text at all every prediction is ``und``; equal texts get equal predictions; ties go to the language that
sorts first; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_or_empty

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
#: Bound of the training sample: windows of each language (about), and of all languages.
WINDOWS_PER_LANGUAGE = 4000
MOST_WINDOWS = 200_000
MOST_LANGUAGES = 500
EPOCHS = 6
BATCH = 64
RATE = 4e-3
#: Windows that are run at once.
STEP = 512
_LETTER = regex.compile(r"\p{L}")


class ByteNetwork:
    """Filters ``kernels[w]`` of shape (w, 256, FILTERS), then a dense layer to the languages."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.kernels = {w: rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _maps(self, x: np.ndarray, w: int) -> np.ndarray:
        k = self.kernels[w]
        out = k[0][x[:, : WINDOW - w + 1]]
        for o in range(1, w):
            out += k[o][x[:, o : WINDOW - w + 1 + o]]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNetwork:
        """Adam on the class-balanced cross-entropy; only the bytes under a filter's maximum get its gradient."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.languages))
        weight = (len(y) / np.maximum(share, 1) / max(1, np.count_nonzero(share))).astype(np.float32)
        parameters = [*self.kernels.values(), self.dense, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
                row = np.arange(len(xb))
                pooled, where = [], []
                for w in WIDTHS:
                    maps = self._maps(xb, w)
                    where.append(maps.argmax(axis=1))
                    pooled.append(np.take_along_axis(maps, where[-1][:, None, :], axis=1)[:, 0, :])
                h = np.maximum(np.concatenate(pooled, axis=1), 0)
                g = _softmax(h @ self.dense + self.bias)
                g[row, yb] -= 1
                g *= weight[yb][:, None] / len(xb)
                up = (g @ self.dense.T) * (h > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    gk = np.zeros_like(self.kernels[w])
                    part = up[:, i * FILTERS : (i + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(gk[o], (xb[row[:, None], where[i] + o], np.arange(FILTERS)[None, :]), part)
                    grads.append(gk)
                grads += [h.T @ g, g.sum(axis=0)]
                step += 1
                for p, (m, v), d in zip(parameters, moments, grads, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        """Each filter width as sums over pairs of bytes (offset, bytes, table): half the look-ups."""
        out = {}
        for w in WIDTHS:
            k = self.kernels[w]
            out[w] = [(o, 2, (k[o][:, None, :] + k[o + 1][None, :, :]).reshape(65536, FILTERS)) for o in range(0, w - 1, 2)]
            if w % 2:
                out[w].append((w - 1, 1, k[w - 1]))
        return out

    def probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """Of each language for each window of bytes."""
        out = np.empty((len(x), len(self.languages)))
        for at in range(0, len(x), STEP):
            part = x[at : at + STEP].astype(np.int32)
            pairs = (part[:, :-1] << 8) | part[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                total = None
                for o, size, table in tables[w]:
                    got = table[(pairs if size == 2 else part)[:, o : o + n]]
                    if total is None:
                        total = got
                    else:
                        total += got
                pooled.append(total.max(axis=1))
            out[at : at + STEP] = _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, padded with zero bytes; the text and the number of bytes of each."""
    count = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    length = np.full(len(flat), WINDOW, np.int64)
    ends = np.cumsum(count)
    for i, t in enumerate(texts):
        if len(t) % WINDOW:
            length[ends[i] - 1] = len(t) % WINDOW
    return flat, owner, length


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over their range (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sampled_windows(known: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``lang``, ``luck``, ``window``: of all windows of all texts (``lang``, ``h``, ``text``) those whose luck is below their language's share.

    A window's luck is a hash of its text and its number, so copies of a text have the same windows in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).cast(pa.binary())
            at = np.array([shares[v] for v in langs])
            for i in range(batch.num_rows):
                data = texts[i].as_buffer()
                n = -(-data.size // WINDOW)
                luck = _mixed(hashes[i] + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                mine = np.flatnonzero(luck < np.uint64(min(at[i], 1.0) * (1 << 40)))
                if len(mine):
                    whole = memoryview(data)
                    windows = [bytes(whole[j * WINDOW : (j + 1) * WINDOW]) for j in mine.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i]] * len(mine)), pa.array(luck[mine].astype(np.int64)), pa.array(windows, pa.binary())], names=["lang", "luck", "window"])

    return known.select("lang", "h", "text").mapInArrow(run, "lang string, luck long, window binary")


def train(labelled: DataFrame, text: str = "text", language: str = "lang") -> ByteNetwork | None:
    """A network fitted on a bounded sample of the windows of ``labelled``; None if there is nothing to learn from."""
    known = labelled.select(F.col(text).alias("text"), F.col(language).cast("string").alias("lang")).where("lang is not null and text is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    size = F.ceil(F.octet_length("text") / WINDOW)
    # Copies of a text count once, so that no hot text crowds out others: the share allows for how many texts are copies.
    counts = known.groupBy("lang").agg(F.sum(size).alias("windows"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("different")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return None
    most = min(WINDOWS_PER_LANGUAGE, max(1, MOST_WINDOWS // len(languages)))
    shares = {r["lang"]: most / max(1.0, r["windows"] * min(1.0, r["different"] / r["n"])) for r in counts}
    drawn = sampled_windows(known, shares).groupBy("lang", "luck", "window").agg(F.count(F.lit(1)).alias("copies"))
    rows = drawn.select("lang", "luck", "window").sort("luck", "lang", "window").limit(2 * most * len(languages)).collect()
    x = np.stack([np.frombuffer(bytes(r["window"]).ljust(WINDOW, b"\0"), np.uint8) for r in rows])
    return ByteNetwork(languages).fit(x, np.array([languages.index(r["lang"]) for r in rows]))


_TABLES: dict[int, tuple[object, dict]] = {}


def predict(docs: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (a clash gets underscores)."""
    pred, score = fresh(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    names, shared = [f.name for f in schema.fields], docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if net is not None and _TABLES.get(0, (None,))[0] is not net:
            _TABLES[0] = (net, net.tables())
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            known = [i for i, v in enumerate(values) if net is not None and v and _LETTER.search(v)]
            found: list[tuple[str, float]] = [("und", 0.0)] * len(values)
            if known:
                flat, owner, length = windows_of([values[i].encode() for i in known])
                sums = np.zeros((len(known), len(net.languages)))
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                sums[:] = np.add.reduceat(net.probabilities(flat, _TABLES[0][1]) * length[:, None], starts, axis=0)
                mean = sums / sums.sum(axis=1, keepdims=True)
                for i, k, s in zip(known, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                    found[i] = (net.languages[k], min(max(s, 0.0), 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id's text modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % by

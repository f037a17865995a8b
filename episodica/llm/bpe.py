"""Byte-pair encoding and decoding of whole texts with a public vocabulary.

A text is cut into pre-tokens as the vocabulary file says; equal chunks between white space are encoded once for each
worker, a text's new ones in one batch.  A pre-token longer than ``LEAF`` characters is encoded by tree concatenation:
its leaves are encoded apart (those of all long pre-tokens in one batch), and at each join a window of the tokens on
both sides is encoded again, growing until its first and last tokens equal those of the two sides.  Since an encoding is right exactly if
each pair of neighbouring tokens is, the joined encoding then equals that of the whole.

Defined cases: a null text counts as empty (no tokens, decoded as the empty string); texts of any length are encoded
whole; repeated rows give equal results; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Characters of a leaf of the tree; a pre-token of at most as many is encoded at once.
LEAF = 16
#: Chunks that a worker remembers before it sets them aside, and forgets those set aside before.
CACHE = 150_000
#: Bytes of text whose outputs a worker holds at once; one text may be longer.
HELD_BYTES = 1 << 20
#: Of a chunk: number of ids, ids, tokens as text, joins.
Piece = tuple[int, bytes, str, int]
#: Characters that ``str.split`` takes for white space and the vocabulary's pattern does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Unicode's white space as a character class; the regex module's own has the four separators too.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(f"[{_SPACE}]+")
#: Marks that no rule of the vocabulary's pattern joins with letters.
_MARKS = {*".,;:!?"}
#: Packers of so many ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class BytePairCoder:
    """Encodes and decodes as the tokenizers library does with this file and no special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocabulary.items()}
        self.names = {i: " " + t for i, t in self.tokens.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", _SPACE))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: One model that ends the word with its string and one for the parts before the last.
        self.ending = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix, cache_capacity=0))
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        #: Of each id, whether its token ends a word.
        self.ends = np.zeros(max(self.tokens) + 1, bool)
        self.ends[[i for i, t in self.tokens.items() if self.suffix and t.endswith(self.suffix)]] = True
        self.bytes_to_chars = _byte_characters()
        self.cache: dict[str, Piece] = {}
        self.before: dict[str, Piece] = {}

    # -- pre-tokens ---------------------------------------------------------------------------------------------

    def _parts(self, parts: list[tuple[str, bool]]) -> list[list[str]]:
        """Tokens of each part, in one batch for those that end their word and one for the others."""
        out: list[list[str]] = [[]] * len(parts)
        for model, ends in ((self.inner, False), (self.ending, True)):
            at = [k for k, p in enumerate(parts) if p[1] == ends]
            for k, e in zip(at, model.encode_batch([parts[k][0] for k in at], add_special_tokens=False) if at else (), strict=True):
                out[k] = e.tokens
        return out

    def _text(self, tokens: list[str], last: bool) -> str:
        text = "".join(tokens)
        return text[: -len(self.suffix)] if last and self.suffix else text

    def _joined(self, joins: list[tuple[list[str], list[str], bool]]) -> list[list[str]]:
        """The encodings of neighbouring parts from theirs, by windows that grow from each join; all joins in one batch."""
        out: list[list[str]] = [[]] * len(joins)
        size, pending = 1, list(range(len(joins)))
        while pending:
            windows = []
            for k in pending:
                left, right, last = joins[k]
                ends = last and size >= len(right)
                windows.append((self._text(left[-size:] + right[:size], ends), ends))
            apart = []
            for k, window in zip(pending, self._parts(windows), strict=True):
                left, right, _ = joins[k]
                a, b = min(size, len(left)), min(size, len(right))
                # A side agrees if its outermost token stands as it was, or if the window holds the whole side.
                if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                    out[k] = left[: len(left) - a] + window + right[b:]
                else:
                    apart.append(k)
            size, pending = 2 * size, apart
        return out

    def encode_long(self, words: list[str], leaf: int = LEAF) -> list[tuple[list[str], int]]:
        """Tree concatenation of pre-tokens, given in byte characters: tokens, and how many joins they took."""
        pieces = [(w[i : i + leaf], i + leaf >= len(w)) for w in words for i in range(0, len(w), leaf)]
        encoded = iter(self._parts(pieces))
        levels = [[next(encoded) for _ in range(0, len(w), leaf)] for w in words]
        joins = [len(level) - 1 for level in levels]
        while any(len(level) > 1 for level in levels):
            at = [(k, i) for k, level in enumerate(levels) for i in range(0, len(level) - 1, 2)]
            done = self._joined([(levels[k][i], levels[k][i + 1], i + 2 == len(levels[k])) for k, i in at])
            new = [[] for _ in levels]
            for (k, _), tokens in zip(at, done, strict=True):
                new[k].append(tokens)
            levels = [n + level[-1:] if len(level) % 2 else n for n, level in zip(new, levels, strict=True)]
        return [(level[0], n) for level, n in zip(levels, joins, strict=True)]

    def _words(self, text: str) -> list[str]:
        """Pre-tokens of normalized text, in byte characters."""
        if text.isalpha() and text.isascii():
            return [text]
        table = self.bytes_to_chars
        return [w if w.isascii() and w.isprintable() else "".join(map(table.__getitem__, w.encode())) for w in self.pattern.findall(text)]

    def _chunks(self, chunks: list[str]) -> None:
        """Remembers the encodings of chunks that are not known, in one batch."""
        words = [self._words(c) for c in chunks]
        short, long = [], []
        for ws in words:
            for w in ws:
                (short if len(w) <= LEAF else long).append(w)
        ids = [e.ids for e in self.ending.encode_batch(short, add_special_tokens=False)]
        trees = [([self.vocabulary[t] for t in tokens], n) for tokens, n in self.encode_long(long)] if long else []
        next_short, next_tree, name, cache = iter(ids).__next__, iter(trees).__next__, self.names.__getitem__, self.cache
        for chunk, ws in zip(chunks, words, strict=True):
            if len(ws) == 1 and len(ws[0]) <= LEAF:
                got, n = next_short(), 0
            else:
                got, n = [], 0
                for w in ws:
                    if len(w) <= LEAF:
                        got += next_short()
                    else:
                        part, k = next_tree()
                        got += part
                        n += k
            cache[chunk] = (len(got), _PACK[len(got)](*got) if len(got) < len(_PACK) else struct.pack(f"<{len(got)}I", *got), "".join(map(name, got)), n)

    # -- whole texts --------------------------------------------------------------------------------------------

    @staticmethod
    def normalized(text: str) -> str:
        """NFC and lower case, each character by itself: the final sigma is not special."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _plain(self, text: str) -> list[Piece]:
        text = self.normalized(text)
        chunks = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        if len(self.cache) > CACHE:
            # What was used since the last time this happened is still at hand; frequent chunks are never encoded again.
            self.cache, self.before = {}, self.cache
        cache = self.cache
        try:
            return [*map(cache.__getitem__, chunks)]
        except KeyError:
            new = []
            for c in {*chunks}:
                if c not in cache:
                    known = self.before.get(c)
                    if known is None:
                        new.append(c)
                    else:
                        cache[c] = known
            if new:
                self._chunks(new)
            return [*map(cache.__getitem__, chunks)]

    def ids_of(self, chunk: str) -> bytes:
        """Ids of one chunk of normalized text without white space, as little-endian 32-bit integers."""
        if chunk not in self.cache:
            self._chunks([chunk])
        return self.cache[chunk][1]

    def ids_of_all(self, chunks: list[str]) -> list[bytes]:
        """What :meth:`ids_of` gives of each chunk; each distinct pre-token is encoded once and nothing is remembered."""
        # Letters with one mark behind them are two pre-tokens, as the pattern says too, which takes longer.
        words = [[c[:-1], c[-1]] if c[-1:] in _MARKS and c[:-1].isalpha() and c.isascii() else self._words(c) for c in chunks]
        different = {w: b"" for ws in words for w in ws}
        short, long = [w for w in different if len(w) <= LEAF], [w for w in different if len(w) > LEAF]
        for at in range(0, len(short), 2048):
            part = short[at : at + 2048]
            (got,) = self.ending.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # the vocabulary does not mark where a word ends
                (got,) = self.ending.encode_batch([part], is_pretokenized=True, add_special_tokens=False)
                last = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            ends, ids = 4 * last, ids.tobytes()
            different.update(zip(part, (ids[i:j] for i, j in pairwise([0, *ends.tolist()])), strict=True))
        if long:
            different.update((w, struct.pack(f"<{len(tokens)}I", *map(self.vocabulary.__getitem__, tokens))) for w, (tokens, _) in zip(long, self.encode_long(long), strict=True))
        return [different[ws[0]] if len(ws) == 1 else b"".join([different[w] for w in ws]) for ws in words]

    def pieces(self, text: str) -> list[Piece]:
        """Number, ids as little-endian 32-bit integers, tokens as text and joins, of each chunk in order."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append((1, struct.pack("<I", self.vocabulary[m[0]]), " " + m[0], 0))
            at = m.end()
        return out + self._plain(text[at:] if at else text)

    def encode(self, text: str | None) -> tuple[int, bytes]:
        got = self.pieces(text or "")
        return sum(x[0] for x in got), b"".join([x[1] for x in got])

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with blanks between; this vocabulary's file names no other decoder."""
        return " ".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def _byte_characters() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_CODERS: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """The worker's own coder for this file, with what it remembers."""
    if path not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CODERS[path] = BytePairCoder(path)
    return _CODERS[path]


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with at most ``size`` bytes in the string ``column``, or one row that has more."""
    ends = np.cumsum([x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests_only: bool = False, with_decoded: bool = True) -> DataFrame:
    """Columns ``keep`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``n_joins`` and, unless ``digests_only``, ``ids`` and (``with_decoded``) ``decoded``."""
    (source,) = fresh(docs.select(*keep), "source_text")
    given = docs.select(*keep, F.col(text).alias(source))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_joins", T.LongType())]
    if not digests_only:
        added += [T.StructField("ids", T.ArrayType(T.LongType()))] + [T.StructField("decoded", T.StringType())] * with_decoded
    schema = T.StructType([*given.schema.fields[:-1], *added])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            at = whole.schema.get_field_index(source)
            for batch in portions(whole, at, HELD_BYTES):
                yield pa.RecordBatch.from_arrays(outputs(own, batch, at), names=names)

    def outputs(own: BytePairCoder, batch: pa.RecordBatch, at: int) -> list[pa.Array]:
        counts, ids, decoded, one, two, joins = [], [], [], [], [], []
        for value in batch.column(at).to_pylist():
            got = own.pieces(value or "")
            packed = b"".join([x[1] for x in got])
            back = "".join([x[2] for x in got])[1:]
            counts.append(sum([x[0] for x in got]))
            one.append(hashlib.sha256(packed).hexdigest())
            two.append(hashlib.sha256(back.encode()).hexdigest())
            joins.append(sum([x[3] for x in got]))
            if not digests_only:
                # Packed ids take 4 bytes each until they are a column; as Python's integers they would take 40.
                ids.append(packed)
                if with_decoded:
                    decoded.append(back)
        columns = [c for k, c in enumerate(batch.columns) if k != at] + [pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(joins, pa.int64())]
        if not digests_only:
            starts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))))
            if with_decoded:
                columns.append(pa.array(decoded, pa.string()))
        return columns

    return given.mapInArrow(run, schema)

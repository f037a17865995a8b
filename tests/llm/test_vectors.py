"""Archives, product codes and clusters against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import exponion, product_codes, warc
from episodica.llm import vectors as V
from episodica.llm.common import shared_path

PAGES = "page_id long, url string, html string, record string, run int, range int, place string"
HARD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages(spark, rows):
    """Captures with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 1, 2, "p") for r in rows], PAGES)


def archived(spark, rows, parts=3, **options):
    path = shared_path(spark, "test-archives")
    df = pages(spark, rows)
    df.coalesce(1).write.option("maxRecordsPerFile", max(1, len(rows) // parts)).parquet(path + "-in")
    warc.write_archives(spark.read.schema(df.schema).parquet(path + "-in"), path, "page_id", "url", "html", F.timestamp_seconds(F.col("page_id") % 7), **options)
    return path


# -- archives --------------------------------------------------------------------------------------------------------


def expected(rows, least=0):
    """By (page_id, html): how often each (bytes, digest, type, refers_to) is due."""
    first = {}
    for i, (p, _, h) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        first.setdefault(h or "", (i, p))
    out = Counter()
    for i, (p, _, h) in enumerate(rows):
        data = (h or "").encode()
        again = len(data) >= least and first[h or ""][0] != i
        out[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""][1] if again else None] += 1
    return out


ROWS = [
    (5, "http://A.example.com/x?b=1#f", "<p>one</p>"), (3, "https://www.a.example.com:443/x?b=1", "<p>one</p>"), (3, "http://b.example.org:8080", HARD), (None, None, None), (9, "", ""), (None, "http://é.example.com/a b\r\nX: y", "<p>one</p>"),
    (7, "http://c.example.com/", "漢字 é \x00 \r\n\r\n"), (7, "http://c.example.com/", "漢字 é \x00 \r\n\r\n"), (8, "not a url", "z" * 300_000), (10, "http://[bad/", HARD + HARD), *[(100 + i, "http://hot.example.com/", "<b>hot</b>") for i in range(60)],
]


def read(index):
    return Counter((r.capture_key and int(r.capture_key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in index.collect())


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, compression):
    path = archived(spark, ROWS, archive_bytes=20_000, compression=compression)
    assert read(warc.read_index(spark, path, 10)) == expected(ROWS)


def test_small_payloads_are_no_revisits(spark):
    path = archived(spark, ROWS, least_bytes=11)
    assert read(warc.read_index(spark, path)) == expected(ROWS, 11)


def test_a_revisit_holds_no_payload(spark):
    path = archived(spark, [(i, "u", "x" * 5000) for i in range(4)], parts=1)
    rows = warc.read_index(spark, path).collect()
    assert sorted(r.length > 5000 for r in rows) == [False, False, False, True] and {r.payload_bytes for r in rows} == {5000}


def test_offsets_lead_to_the_records(spark):
    path = archived(spark, ROWS)
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    for r in warc.read_index(spark, path).collect():
        data = files[r.archive][r.offset : r.offset + r.length]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and r.record_id.encode() in data


def test_histories_are_ordered_over_ranges(spark):
    path = archived(spark, ROWS, parts=4)
    rows = warc.histories(warc.read_index(spark, path, 7)).orderBy("range", "place").collect()
    assert len({r.range for r in rows}) > 3 and len(rows) == len(ROWS)
    keys = [(r.url_key, r.captured, r.archive, r.offset) for r in rows]
    assert keys == sorted(keys)
    for key in {k[0] for k in keys}:
        assert [r.capture for r in rows if r.url_key == key] == list(range(1, 1 + sum(k[0] == key for k in keys)))
    hot = [r for r in rows if r.url_key == "com,example,hot)/"]
    assert len(hot) == 60 and len({r.range for r in hot}) > 2  # one URL is many ranges


def test_url_keys():
    assert warc.url_key("http://www.Example.com/") == warc.url_key("https://example.com:443") == "com,example)/"
    assert warc.url_key("http://a.b.c:81/p?q=1#z") == "c,b,a:81)/p?q=1" and warc.url_key("") == "" and warc.url_key("http://[bad/") == "http://[bad/"


def test_loser_tree_merges_like_sorting():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 40):
        runs = [sorted((rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.merged(runs)) == sorted(x for r in runs for x in r)


def test_a_cut_archive_is_an_error(spark):
    path = archived(spark, [(1, "u", "abc"), (2, "u", "abd")], parts=1)
    data = next(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert len(list(warc.records("a", data))) == 2
    for bad in (data[:-1], data[:-30], data[: len(data) // 2 + 9], data.replace(b"abd", b"abe")):
        with pytest.raises(ValueError, match="a (ends|holds|has)"):
            list(warc.records("a", bad))


def test_no_captures(spark):
    path = archived(spark, [])
    assert warc.histories(warc.read_index(spark, path)).count() == 0


# -- vectors ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id string, cluster string, codes int, error string"


def embeddings(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, k, "x", "c", 1, "e") for i, v, k in rows], VECTORS).repartition(parts)


def lloyd(x, centers, rounds):
    """Labels, squared distances and centers by comparing everything with everything."""
    def nearest():
        d = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        label, _ = nearest()
        centers = np.array([x[label == j].sum(axis=0) // (label == j).sum() if (label == j).any() else centers[j] for j in range(len(centers))])
    return *nearest(), centers


def clouds(seed, n, length, step=1 / 8):
    """Vectors on a coarse grid around a few points, so that there are ties, repeats and negative floors."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(-4, 5, (6, length))
    return [((middle[rng.integers(6)] + rng.integers(-2, 3, length)) * step).tolist() for _ in range(n)]


BAD = [(900, None, 1), (901, [], 1), (902, [1.0] * 7, 2), (903, [float("nan")] * 8, 1), (904, [1.0] * 7 + [None], None), (905, [float("-inf")] + [0.0] * 7, 1)]


@pytest.mark.parametrize(("n", "block", "k"), [(700, 100, 8), (700, 33, 40), (5, 2, 8), (1, 9, 8), (60, 9, 1)])
def test_exponion_equals_lloyd(spark, n, block, k):
    rows = [(i // 2 if i % 7 else None, v, i % 3) for i, v in enumerate(clouds(n + k, n, 8, 1 / 1024 if k == 40 else 1 / 8))]
    found = exponion.cluster(embeddings(spark, rows + BAD), "vec_id", "embedding", length=8, k=k, rounds=6, block=block)
    chosen = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v, _ in rows)[:k]
    whole = lambda vs: np.floor(np.array(vs, np.float32).astype(float) * 1024).astype(np.int64)
    x = whole([v for _, v, _ in rows])
    label, distance, centers = lloyd(x, whole([v for _, v in chosen]), 6)
    assert found.centroids.tolist() == centers.tolist()
    inertia = np.bincount(label, distance, len(centers)).astype(int)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    want = Counter((i, int(c), int(d), int(inertia[c]), int(inertia.sum()), digest[c]) for (i, _, _), c, d in zip(rows, label, distance, strict=True))
    assert Counter(map(tuple, exponion.members(found).collect())) == want


def test_exponion_looks_at_few_centroids():
    rng = np.random.default_rng(5)
    middle = rng.integers(-20_000, 20_000, (64, 6))
    x = (middle[rng.integers(64, size=4000)] + rng.integers(-300, 300, (4000, 6))).astype(np.int64)
    centers = middle.copy()
    label, upper, lower, _ = exponion.first_assignment(x, centers)
    for _ in range(4):
        before, centers = centers, V.moved(centers, V.sums_by(label, x, 64))
        label, upper, lower, taken = exponion.assign(x, label, upper, lower, exponion.Geometry.of(centers, before))
        d = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        assert (label == d.argmin(axis=1)).all() and taken < d.size / 10
        assert (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(np.sort(d, axis=1)[:, 1])).all()


def test_filtering_equals_comparing_all():
    rng = np.random.default_rng(2)
    for n, k, spread in ((1, 3, 5), (400, 16, 3), (3000, 40, 500), (3000, 40, 30_000)):
        middle = rng.integers(-spread, spread, (12, 5))
        x = middle[rng.integers(12, size=n)] + rng.integers(-2, 3, (n, 5))
        entries = np.concatenate([x[rng.integers(n, size=k - 1)], x[:1]]).astype(np.int64)
        tree, found = product_codes.Tree.of(V.narrow(x)), np.empty(n, np.int64)
        total, whole = tree.filtered(entries, found)
        labels = np.empty(n, np.int64)
        labels[tree.order] = found
        d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (labels == d.argmin(axis=1)).all() and (total == V.sums_by(d.argmin(axis=1), x, k)).all()
        assert whole > 0 or n < 500 or spread < 500


@pytest.mark.parametrize(("n", "block", "entries"), [(500, 70, 32), (90, 500, 256), (1, 4, 8)])
def test_product_codes_equal_brute_force(spark, n, block, entries):
    rows = [(i // 2 if i % 9 else None, v, [None, 1, 1, 1, 2][i % 5]) for i, v in enumerate(clouds(n, n, 8))]
    found = product_codes.compress(embeddings(spark, rows + BAD), "vec_id", "embedding", "label", parts=2, entries=entries, rounds=3, block=block)
    x = np.floor(np.array([v for _, v, _ in rows], np.float32).astype(float) * 1024).astype(np.int64)
    chosen = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    parts = [lloyd(x[:, 4 * p : 4 * p + 4], x[chosen, 4 * p : 4 * p + 4], 3) for p in range(2)]
    assert found.codebooks.tolist() == [c.tolist() for _, _, c in parts]
    error = parts[0][1] + parts[1][1]
    by = Counter()
    for (_, _, k), e in zip(rows, error, strict=True):
        by[k] += int(e)
    want = Counter((i, f"{a:02x}{b:02x}", int(e), by[k]) for (i, _, k), a, b, e in zip(rows, parts[0][0], parts[1][0], error, strict=True))
    out = product_codes.with_label_errors(found.rows).select("id", product_codes.hexadecimal("codes"), "error", "label_error")
    assert Counter(map(tuple, out.collect())) == want


def test_no_vectors(spark):
    for rows in ([], BAD[:1], BAD[3:]):
        assert product_codes.compress(embeddings(spark, rows), "vec_id", "embedding", "label") is None
        assert exponion.cluster(embeddings(spark, rows), "vec_id", "embedding") is None


def test_large_components_are_exact_or_refused(spark):
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 5], [0, 0]])
    centers = np.array([[1 << 26, 1 << 26], [-(1 << 26), 0]])
    assert V.squared(x, centers).tolist() == ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).tolist()
    with pytest.raises(Exception, match="larger than 65536"):
        exponion.cluster(embeddings(spark, [(1, [1e6] * 8, 1)]), "vec_id", "embedding", length=8)


def test_parts_must_divide(spark):
    with pytest.raises(ValueError, match="do not divide"):
        product_codes.compress(embeddings(spark, BAD[2:3]), "vec_id", "embedding", "label")

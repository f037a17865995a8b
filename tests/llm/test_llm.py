"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from episodica.llm import bpe, decontamination, language_id, language_model, near_duplicates, pseudonyms, quality_classifier, quality_rules, sharding
from episodica.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, record string, size int, shard string, score string, matches string, class_id string, n_pseudonyms string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def table(spark, texts, ids=None):
    """Documents with further columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", 1, "s", "v", "m", "c", "p") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


HARD = [None, "", " \n\t", "one", "a b c d e f g h " * 8, prose(1, 3000), "same text", "same text", "x" * 5000, "é漢字 \x1c y", "<|endoftext|> z"]


DATA = "/root/testdata/sf0.01"


def test_languages_of_the_given_documents(spark):
    """Held-out accuracy of the query itself; what is held out is not read for learning."""
    from episodica.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, DATA).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_training_windows_are_all_windows_once(spark):
    """Whole texts of any length are cut into windows; copies add none, and a full share leaves none out."""
    from pyspark.sql import functions as F

    texts = ["ab" * 3000, "short", "é" * 1000, "short", "ab" * 3000]
    known = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").withColumn("h", F.xxhash64("text")).select("lang", "h", "text").repartition(2)
    got = language_id.sampled_windows(known, {"en": 1.0}).distinct().collect()
    want = {(t, i) for t in texts for i in range(0, len(t.encode()), language_id.WINDOW)}
    assert len(got) == len(want) and {bytes(r.window) for r in got} == {t.encode()[i : i + language_id.WINDOW] for t, i in want}
    some = language_id.sampled_windows(known, {"en": 0.3}).distinct().count()
    assert 0 < some < len(want) / 2


# -- sharding --------------------------------------------------------------------------------------------------------


def test_shards_are_whole_gapless_and_even(spark):
    texts = HARD + [prose(i, 30) for i in range(90)] + ["copy"] * 60
    ids = [None, None, 5, 5, *range(10, 10 + len(texts) - 4)]
    out = sharding.external_shuffle(table(spark, texts, ids), 8, bucket_bytes=4000)
    assert out.columns[0] == "record" and out.select("record.*").columns == table(spark, []).columns
    rows = out.collect()
    assert Counter((r.record.doc_id, r.record.text) for r in rows) == Counter(zip(ids, texts, strict=True))
    for r in rows:
        data = (r.record.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert len({r.bucket for r in rows}) > 3


def test_order_is_random_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    one, two = ([(r.record.doc_id, r.shard, r.slot) for r in sharding.external_shuffle(docs, 2).orderBy("shard", "slot").collect()] for _ in range(2))
    assert one == two
    ids = [x[0] for x in one]
    assert abs(np.corrcoef(ids, range(400))[0, 1]) < 0.6 and ids != sorted(ids)


def test_sharding_of_nothing(spark):
    assert sharding.external_shuffle(table(spark, []), 4).count() == 0


# -- quality rules ---------------------------------------------------------------------------------------------------


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len({*lines}), len(covered)


def brute_scores(texts, good):
    import xxhash

    h = lambda v, seed=42: xxhash.xxh64_intdigest(v, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams = []
    for t in texts:
        w = [h(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        pairs = [h(struct.pack("<Q", b), h(struct.pack("<Q", a))) for a, b in zip(w, w[1:])]
        grams.append([signed(x) % quality_rules.SLOTS for x in w + pairs])
    raw, target = Counter(s for g in grams for s in g), Counter(s for i, g in enumerate(grams) if i in good for s in g)
    nr, nt = raw.total() + quality_rules.SLOTS, target.total() + quality_rules.SLOTS
    return [sum(math.log((target[s] + 1) / nt) - math.log((raw[s] + 1) / nr) for s in g) / len(g) if g else None for g in grams]


def test_quality_rules_against_brute_force(spark):
    texts = HARD + [prose(i, 40) for i in range(20)] + [prose(99, 10) + "\n" + prose(99, 10) + "\n" + prose(99, 10), "# $ % " * 30, " ".join(["a b c d e f g h i"] * 3) + " " + prose(3, 30)]
    good = set(range(12, 25))
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(None, 1, 0), (11, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.record.doc_id: r for r in quality_rules.score_documents(table(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    for i, (t, s) in enumerate(zip(texts, brute_scores(texts, good), strict=True)):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert (r.score is None) == (s is None) and (s is None or math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-12))
        assert r.kept == (not r.base_failed and s is not None and s >= quality_rules.THRESHOLD)


def test_quality_rules_of_nothing(spark):
    assert quality_rules.score_documents(table(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# -- near duplicates -------------------------------------------------------------------------------------------------


def edited(text, k, seed):
    w, rng = text.split(), random.Random(seed)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"z{rng.random()}"
    return " ".join(w)


def test_classes_against_brute_force(spark):
    texts = [prose(i, 200) for i in range(25)] + HARD + ["Same  TEXT"]
    texts += [edited(texts[k % 5], 2, 100 + k) for k in range(40)] + [edited(texts[7], 30, 7)]
    got = {r.doc_id: r["_class_id"] for r in near_duplicates.classify(table(spark, texts)).collect()}
    shingles = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else Counter() for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = (shingles[i] & shingles[j]).total(), (shingles[i] | shingles[j]).total()
            if both >= 0.8 * either:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert [got[i] for i in range(len(texts))] == group


def test_classes_in_a_large_bucket_against_brute_force(spark):
    # All share a passage that makes them 0.74 alike; every fourth of them has a copy that is 0.81 like it.
    shared = prose(0, 120)
    texts = [f"{shared} {prose(10_000 + i, 20)}" for i in range(1200)]
    texts += [" ".join(t.split()[:126]) + f" {prose(90_000 + i, 14)}" for i, t in enumerate(texts[::4])]
    nodes = near_duplicates.signatures(table(spark, texts))
    largest = near_duplicates.shared_buckets(nodes).agg({"n": "max"}).first()[0]
    assert largest > 1000
    got = {r.doc_id: r["_class_id"] for r in near_duplicates.classify(table(spark, texts)).collect()}
    shingles = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    names = {s: k for k, s in enumerate({s for c in shingles for s in c})}
    assert max(max(c.values()) for c in shingles) == 1
    has = np.zeros((len(texts), len(names)), np.float32)
    for i, c in enumerate(shingles):
        has[i, [names[s] for s in c]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    similar = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    group = np.arange(len(texts))
    while (lower := np.where(similar, group[None, :], len(texts)).min(axis=1)).tolist() != group.tolist():
        group = lower
    assert len(set(group.tolist())) < len(texts)
    assert [got[i] for i in range(len(texts))] == group.tolist()


def test_a_link_that_fails_joins_nothing():
    # A-B is 0.79 but estimated 0.86, A-C 0.86, C-B 0.81: C-B is tried though A-B and A-C came first.
    exact = {(0, 1): 0.79, (0, 2): 0.86, (1, 2): 0.81}
    i, j, similar = np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([0.862, 0.861, 0.81])
    links = near_duplicates.tile_links(i, j, similar, [0, 1, 2], lambda x, y: exact[x, y] >= near_duplicates.THRESHOLD)
    assert links == [(0, 2), (1, 2)]


def test_keep_one_with_null_and_repeated_ids(spark):
    texts, ids = [prose(1, 50), prose(1, 50), prose(2, 50), prose(2, 50), prose(3, 50)], [None, 7, 4, 4, None]
    kept = near_duplicates.keep_one(table(spark, texts, ids))
    assert kept.columns == table(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, texts[0]), (4, texts[2]), (None, texts[4])], key=repr)
    assert near_duplicates.keep_one(table(spark, [])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:270], rng.integers(0, 2**63, 30).astype(np.uint64)])
    a, b = np.concatenate([a, a[:100]]), np.concatenate([b, b[:50]])
    s = near_duplicates.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - near_duplicates.weighted_jaccard(a, b)) < 0.03


# -- places of passages ---


def test_every_place_of_a_passage_is_a_match(spark):
    item = [f"q{i}" for i in range(80)]
    near = [w if i != 40 else "other" for i, w in enumerate(item)]
    filler = prose(77, 60).split()
    texts = [filler + item + filler + item, item + item + near, item * 2, filler + near + filler + item + filler, ["x"] * 50]
    benchmark = spark.createDataFrame([(5, " ".join(item)), (6, "x " * 12)], "item_id long, text string")
    rows = {r.doc_id: r["_matches"] for r in decontamination.with_matches(table(spark, [" ".join(t) for t in texts]), benchmark).collect()}
    places = lambda doc, item: [(m["first_word"], m["n_words"], m["similarity"] == 1.0) for m in rows[doc] if m["item"] == item]
    assert places(0, 5) == [(60, 80, True), (200, 80, True)] and places(1, 5) == [(0, 80, True), (80, 80, True), (160, 80, False)]
    assert places(2, 5) == [(0, 80, True), (80, 80, True)] and places(3, 5) == [(60, 80, False), (200, 80, True)]
    runs = places(4, 6)
    assert len(runs) == 4 and all(b[0] >= a[0] + a[1] for a, b in zip(runs, runs[1:], strict=False)) and all(exact for *_, exact in runs)


def test_spans_that_share_words_go_to_the_better():
    assert decontamination.apart([(0.9, 0, 10), (1.0, 5, 10), (0.8, 15, 3), (0.85, 14, 4), (0.9, 30, 5), (0.9, 32, 5), (0.9, 0, 10)]) == [(1.0, 5, 10), (0.8, 15, 3), (0.9, 30, 5)]


# -- decontamination -------------------------------------------------------------------------------------------------


def test_benchmark_passages_and_edits(spark):
    items = [prose(1000 + i, n) for i, n in enumerate((3, 6, 12, 20, 35, 59, 90))] + [None, ""]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = [*HARD, prose(5, 300)], []
    for i, item in enumerate(items[:7]):
        for k in range(3):
            w = item.split()
            if k and len(w) >= 59:
                w.insert(len(w) // 2, "inserted") if k == 1 else w.pop(len(w) // 2)
            if k == 0 or len(w) >= 58:
                want.append((len(texts), i))
            elif k:
                w = [f"q{x}" for x in w]
            texts.append(prose(50 + k, 40) + ", " + " ".join(w).upper() + "! " + prose(60 + k, 40))
    rows = decontamination.with_matches(table(spark, texts), benchmark).collect()
    assert sorted((r.doc_id, m.item) for r in rows for m in r["_matches"]) == want
    assert decontamination.with_matches(table(spark, []), benchmark).count() == 0
    assert {len(r["_matches"]) for r in decontamination.with_matches(table(spark, texts[:3]), benchmark.limit(0)).collect()} == {0}


def spans_found(words, items, similar=0.8):
    """Items with a span of the document at the similarity or above, by trying every span."""
    of = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter({tuple(w): 1})
    found = set()
    for i, item in enumerate(items):
        b, n = of(item), len(item)
        spans = ((x, y) for x in range(len(words)) for y in range(x + 1, min(len(words), x + n + n // 3 + 2) + 1) if y - x >= 0.7 * n)
        if any((a & b).total() >= similar * (a | b).total() for a in (of(words[x:y]) for x, y in spans)):
            found.add(i)
    return found


def test_benchmark_passages_against_brute_force(spark):
    rng = random.Random(12)
    items = [[f"i{rng.randrange(60)}" for _ in range(n)] for n in (4, 9, 30, 55, 70, 70)]
    texts = []
    for k in range(60):
        passage = list(items[k % len(items)])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randrange(2)] = ["new"] * rng.randrange(2)
        cut = rng.randrange(4)
        texts.append(["w1"] * rng.randrange(3) + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))] + passage[cut:] + ["z"] * rng.randrange(3))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontamination.with_matches(table(spark, [" ".join(t) for t in texts]), benchmark).collect()
    got = {r.doc_id: {m.item for m in r["_matches"]} for r in rows}
    want = {k: spans_found(t, items) for k, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 20


def test_an_item_of_thousands_of_words(spark):
    item = [f"i{k}" for k in range(3000)]
    edited = [w for k, w in enumerate(item) if k % 60]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    texts = [prose(1, 500) + " " + " ".join(edited) + " " + prose(2, 500), " ".join(item[:1500])]
    got = {r.doc_id: r["_matches"] for r in decontamination.with_matches(table(spark, texts), benchmark).collect()}
    assert [m.item for m in got[0]] == [7] and 0.8 <= got[0][0].similarity < 1 and got[0][0].first_word == 500 and not got[1]


def test_shared_run_is_a_bound():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(5, 120)
        item = [f"i{x}" for x in range(n)]
        passage = list(item)
        for _ in range(rng.randrange(4)):
            at, what = rng.randrange(len(passage)), rng.random()
            passage[at : at + 1] = [] if what < 0.3 and len(passage) > 1 else [passage[at], "new"] if what < 0.6 else ["new"]
        shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        a, b = shingles(item), shingles(passage)
        if (a & b).total() >= 0.8 * (a | b).total():
            runs = "".join("1" if f"i{x}" in passage and (x == 0 or (f"i{x - 1}" in passage and passage.index(f"i{x}") == passage.index(f"i{x - 1}") + 1)) else " 1" if f"i{x}" in passage else " " for x in range(n))
            assert max(map(len, runs.split())) >= decontamination.shared_run(n)


# -- tokens ----------------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(4)
    texts = [*HARD, "ΣΑΣ İ don't we'll'VE 's", "".join(rng.choices("thanderig é漢", k=4000)).replace(" ", ""), "!" * 3000, "a\x85b c", "x<|startoftext|>y"]
    rows = {r.doc_id: r for r in bpe.encode_and_decode(table(spark, texts), path, keep=("doc_id", "score")).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        r = rows[i]
        assert (r.n_tokens, r.ids, r.decoded, r.score) == (len(want), want, back, "v")
        assert (r.n_joins > 0) == any(len(w.encode()) > bpe.LEAF for w in re.findall(r"[a-zx漢é]+|!+", (t or "").lower())), t
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_and_decode(table(spark, []), path).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 17])
def test_tree_concatenation_with_small_leaves(leaf):
    own, rng = bpe.coder(vocabulary_path("word_bpe_49k.json")), random.Random(leaf)
    words = ["".join(rng.choices(letters, k=n)) for n in (1, 2, 5, 40, 333) for letters in ("thandering", "ab", "abcdefghijklmnopqrstuvwxyz")]
    for word, (tokens, joins) in zip(words, own.encode_long(words, leaf), strict=True):
        assert tokens == own.ending.encode(word, add_special_tokens=False).tokens
        assert joins == -(-len(word) // leaf) - 1


def test_bpe_holds_a_portion_of_a_batch_at_once(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    path, rng = vocabulary_path("word_bpe_49k.json"), random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = [None if i % 500 == 3 else " ".join(rng.choices(words, k=300)) for i in range(4000)] + [" ".join(rng.choices(words, k=300_000)), "", None]
    docs = table(spark, [""])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = bpe.encode_and_decode(docs, path)
    own = bpe.coder(path)
    own.pieces(" ".join(words))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "source_text"])
    tracemalloc.start()
    try:
        for _ in run(iter([batch.slice(0, 4000)])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 20 << 20  # 6 MB of text, whose ids as Python's integers take over 100
    finally:
        tracemalloc.stop()
    rows = [r for out in run(iter([batch.slice(0, 0), batch.slice(3990), batch.slice(7, 5)])) for r in out.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(3990, 4003), *range(7, 12)]
    for r in rows:
        n, packed = own.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (n, np.frombuffer(packed, "<u4").tolist(), own.decode(packed))


# -- personal data ---------------------------------------------------------------------------------------------------


def test_pseudonyms_keep_format_link_and_invert(spark):
    texts = [
        "mail a.b7@x.org and a.b7@x.org", "card 4111 1111 1111 1111, 4111111111111111; no 4111111111111112", "call +1 (743) 555-3824 or 743-555-3824 175",
        "ip 227.5.221.1 not 999.1.1.1 nor 1.2.3", "born 1985-02-28, 31/12/2020, not 2024-02-30", "DE89370400440532013000 not DE88370400440532013000", "ssn 123-45-6789 not 000-12-3456", None, "", "no number",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x" * 20000 + " a@b.com",
    ]
    moved = pseudonyms.pseudonymize(table(spark, texts), "k").cache()
    got = {r.doc_id: r for r in moved.collect()}
    assert [got[i]["_n_pseudonyms"] for i in range(len(texts))] == [2, 2, 2, 1, 2, 1, 1, 0, 0, 0, 1, 1]
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", t))
    for i in (0, 1, 2, 5, 6):
        assert shape(got[i].text) == shape(texts[i]) and got[i].text != texts[i]
    first, second = re.findall(r"\S+@x.org", got[0].text)
    assert first == second
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"(?:\d[ ]?){16}", got[1].text)]
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10
    assert digits[0] == digits[1] and luhn(digits[0]) == 0 and digits[2] == "4111111111111112"
    assert got[7].text is None and got[8].text == "" and got[9].text == "no number"
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymize(moved, "k", inverse=True).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert pseudonyms.pseudonymize(table(spark, []), "k").count() == 0


def test_dates_and_numbers_keep_length_stay_valid_and_come_back(spark):
    rng = random.Random(8)
    values = {f"{d}/{m}/{y}" for d in range(1, 32) for m in (1, 2, 9, 11, 12) for y in (1900, 2024)} | {f"{m:02}/{d:02}/{y}" for d in range(1, 32) for m in (1, 2, 9, 10, 12) for y in (1950, 2099)}
    values |= {f"{d:02}.{m}.{y}" for d in range(1, 32) for m in (3, 12) for y in (2001,)} | {f"2{rng.randrange(100):03}-{m:02}-{d:02}" for m in range(1, 13) for d in (1, 28, 31)}
    values |= {f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10_000):04}" for _ in range(900)}
    values = sorted(values)
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(4)
    moved = pseudonyms.pseudonymize(docs, "k").cache()
    got = {r.doc_id: r for r in moved.collect()}
    assert all(len(got[i].text) == len(v) and re.sub("[0-9]", "9", got[i].text) == re.sub("[0-9]", "9", v) for i, v in enumerate(values))
    changed = [i for i in range(len(values)) if got[i].n_pseudonyms]
    assert len(changed) > 1200 and len({got[i].text for i in changed}) == len(changed)
    assert not any(re.search("^(000|666|9)..-|-00-|-0000$", got[i].text) for i in changed if values[i].count("-") == 2 and len(values[i]) == 11)
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymize(moved.drop("n_pseudonyms"), "k", inverse=True).collect()}
    assert [back[i] for i in range(len(values))] == values


def test_a_written_date_is_permuted_within_its_format(spark):
    """All dates of a format have different pseudonyms, which are all dates of the format."""
    rows = [(f"{m:02}/{d:02}/{y}",) for y in range(1900, 1940) for m in range(1, 13) for d in range(1, 29)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "v string").repartition(4).select("v", pseudonyms._written_date(F.col("v"), "k", False).alias("p")).collect()
    assert len({r.p for r in got}) == len(rows)
    assert all((int(r.v[:2]) > 12 or int(r.v[3:5]) <= 12) == (int(r.p[3:5]) <= 12) for r in got)


def test_number_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    n = math.prod(pseudonyms.DAY_HALVES)
    assert n == 73049
    moved = spark.range(n).select(pseudonyms.permute_number(F.col("id"), pseudonyms.DAY_HALVES, "k", "date").alias("m")).agg(F.count_distinct("m").alias("d"), F.min("m").alias("low"), F.max("m").alias("high")).first()
    assert (moved.d, moved.low, moved.high) == (n, 0, n - 1)


# -- models ----------------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    rng = random.Random(0)
    say = lambda syllables, n: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(n))
    kinds = {"aa": ["the", "ing", "on"], "bb": ["sch", "ü", "ein"], "cc": ["eau", "é", "que"]}
    rows = [(i, say(kinds[k], rng.choice([3, 40, 400])), k) for i in range(240) for k in [list(kinds)[i % 3]]] + [(900, None, "aa"), (901, "123 !", "bb"), (902, say(kinds["aa"], 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = docs.withColumn("held", language_id.remainder("doc_id", 5) == 0)
    got = language_id.predict(held.withColumnRenamed("lang", "score"), language_id.train(held.where("not held"))).collect()
    assert all(0 <= r["_score"] <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901)} == {900: "und", 901: "und"}
    tested = [r.lang_pred == r.score for r in got if r.held and r.doc_id < 900]
    assert sum(tested) >= 0.95 * len(tested)
    assert language_id.predict(docs.where("false"), language_id.train(docs)).count() == 0
    none = language_id.train(docs.where("lang = 'zz'"))
    assert none is None and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_ordinal_grades(spark):
    rng = random.Random(5)
    texts, rows = [], []
    for i in range(600):
        quality, toxic = int(rng.random() < 0.7), int(rng.random() < 0.3)
        texts.append(prose(i, 60) + (" good fine" if quality else " bad%%% junk%%%") + (" nasty, vile" if toxic else ""))
        rows.append((i, quality, toxic))
    texts += [None, "", texts[0]]
    labels = spark.createDataFrame([r for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    got = {r.doc_id: r for r in quality_classifier.classify(docs, quality_classifier.train(docs, labels)).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(round(got[i].expected_grade) == q + 1 - t for i, q, t in held) >= 0.97 * len(held)
    assert sum(got[i].kept == (q == 1 and t == 0) for i, q, t in held) >= 0.97 * len(held)
    assert not got[600].kept and (got[601].expected_grade, got[601].tail) == (0.0, 0.0) and got[602].tail == got[0].tail
    none = quality_classifier.train(docs, labels.limit(0))
    assert none is None and not any(r.kept for r in quality_classifier.classify(docs, none).collect())


def test_rare_toxic_words_are_caught(spark):
    rng = random.Random(6)
    rows = [(i, 1, int(rng.random() < 0.3)) for i in range(900)]
    texts = [prose(i, 60) + (f" vile{rng.randrange(20)}" if toxic else "") for i, _, toxic in rows]
    docs, labels = table(spark, texts), spark.createDataFrame([r for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(docs, quality_classifier.train(docs, labels)).collect()}
    toxic, clean = ([kept[i] for i, _, t in rows if i % 3 == 0 and t == k] for k in (1, 0))
    assert sum(toxic) <= 0.2 * len(toxic) and sum(clean) >= 0.9 * len(clean)


def test_language_model_scores(spark):
    path = vocabulary_path("word_bpe_49k.json")
    texts = [*HARD, *[prose(i % 7, 60) for i in range(60)]]
    got = {r.doc_id: r for r in language_model.score(table(spark, texts), path).collect()}
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for t in texts]
    c = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n, v = c.total(), len(c)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert got[6].score == got[7].score and language_model.score(table(spark, []), path).count() == 0


def test_training_reads_every_subword(spark):
    path = vocabulary_path("word_bpe_49k.json")
    own = bpe.coder(path)
    end = own.vocabulary["<|endoftext|>"]
    classes, _ = language_model.vocabulary_classes(max(own.tokens) + 1, {})
    of, texts = language_model._pieces(path), [prose(1, 3000), None, prose(2, 64), prose(3, 900)]
    p, rows, targets = language_model.start_parameters(), [], []
    for text in texts:
        ids = np.append(np.frombuffer(b"".join(map(of, language_model.tokens_of(text))), np.uint32).astype(np.int64), end)
        row, target = language_model.windows(ids, classes)
        assert target[target >= 0].tolist() == classes[ids].tolist() and row[target >= 0].tolist() == [language_model.ROWS, *(ids[:-1] % language_model.ROWS)]
        rows.append(row)
        targets.append(target)
    p = language_model.train(p, np.concatenate(rows), np.concatenate(targets))
    got = language_model.train_distributed(spark.createDataFrame([(0, t) for t in texts], "block int, text string").coalesce(1), path, classes, end)
    assert np.allclose(language_model.pack(got), language_model.pack(p), atol=1e-4)


def test_the_model_is_a_function_of_the_corpus(spark, monkeypatch):
    """Other partitions and another order give the same scores; a hot text is spread over blocks; rows stay whole."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 20_000)
    path = vocabulary_path("word_bpe_49k.json")
    rows = [(i, prose(i, 120)) for i in range(90)] + [(7, prose(7, 120))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted((r.doc_id, r.score) for r in language_model.score(docs.repartition(5), path).collect())
    two = sorted((r.doc_id, r.score) for r in language_model.score(docs.orderBy("text").coalesce(2), path).collect())
    assert len(one) == len(rows) and np.allclose([s for _, s in one], [s for _, s in two], rtol=1e-4)
    monkeypatch.setattr(language_model, "REPEATS", 10)
    hot = spark.createDataFrame([(1, "same words again")] * 600, "doc_id long, text string")
    assert language_model.dealt(hot, 8).select("block").distinct().count() == 8
    assert {r.score for r in language_model.score(hot, path).collect()}.__len__() == 1


def test_the_network_beats_the_unigram_on_unseen_text(spark):
    """Where the next word follows from the one before, held-out text is likelier than under the word counts."""
    path, rng = vocabulary_path("word_bpe_49k.json"), random.Random(3)

    def chained(n):
        at, out = rng.randrange(30), []
        for _ in range(n):
            out.append(("the", "of", "and", "to", "in", "is", "was", "for", "on", "with", "as", "by", "at", "from", "it", "an", "be", "this", "that", "are", "or", "his", "her", "not", "but", "have", "had", "they", "you", "which")[at])
            at = (at * 7 + 3 + (rng.random() < 0.15)) % 30
        return " ".join(out)

    docs = spark.createDataFrame([(i, chained(400)) for i in range(400)], "doc_id long, text string").repartition(2)
    held = [r for r in language_model.score(docs, path).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.93 * sum(r.base_score for r in held)


def test_words_are_counted_and_encoded_once_for_all_blocks(spark):
    path, own = vocabulary_path("word_bpe_49k.json"), bpe.BytePairCoder(vocabulary_path("word_bpe_49k.json"))
    texts = [(t or "").lower() for t in HARD] + [" odd, ends. ", "Don't stop-here: 3.5 ... x!? é, ﬁ. '"] + [prose(i, 40) for i in range(30)]
    rows = sorted((i % 3, i, i % 4 == 0, t) for i, t in enumerate(texts * 2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a block's texts come in several batches
    try:
        read = language_model.indexed(spark.createDataFrame(rows, "block int, doc_id long, held_out boolean, text string").coalesce(1), 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = {}
    for r in read:
        if r.bucket is not None:
            names[r.block] = names.get(r.block, {}) | dict(zip(np.frombuffer(language_model._unpacked(r.own), np.uint32).tolist(), language_model._unpacked(r.words).split(b" "), strict=True))
    for r in read:
        if r.bucket is None:
            assert [names[r.block][i] for i in np.frombuffer(language_model._unpacked(r.own), np.uint32).tolist()] == language_model.tokens_of((texts * 2)[r.doc_id])
    buckets = spark.createDataFrame([(r.bucket, r.block, r.own, r.words, r.n) for r in read if r.bucket is not None], "bucket int, block int, own binary, words binary, n binary")
    got = language_model.unified(buckets.coalesce(1).sortWithinPartitions("bucket"), path).collect()
    want = Counter(w for _, _, held, t in rows if not held for w in language_model.tokens_of(t))
    assert sum(r.v for r in got if r.block is None) == len(want) and sum(r.all_n for r in got if r.block is None) == want.total()
    of = language_model._pieces(path)
    for r in got:
        if r.block is not None:
            words = [names[r.block][i] for i in np.frombuffer(language_model._unpacked(r.own), np.uint32).tolist()]
            assert np.frombuffer(language_model._unpacked(r.n), np.int64).tolist() == [want[w] for w in words]
            assert language_model._unpacked(r.ids) == b"".join(map(of, words))
    calls, batch = [], own.ending.encode_batch_fast
    own.ending = type("Counting", (), {"encode_batch_fast": lambda self, x, **options: (calls.append(1), batch(x, **options))[1]})()
    many = [w + mark for w in WORDS for mark in ("", ",", ".")]
    assert own.ids_of_all(many) == [*map(bpe.coder(path).ids_of, many)] and len(calls) == 1


def test_training_and_scores_equal_plain_attention():
    """Against softmax and Adam as they are written, in double precision; large parameters too."""
    rng, w, size = np.random.default_rng(4), language_model.WIDTH, 2 * language_model.SEGMENT
    rows, targets = rng.integers(0, 90, (70, size)).astype(np.int16), rng.integers(-1, 128, (70, size)).astype(np.int16)
    gap = np.arange(size)[:, None] - np.arange(size)[None, :]

    def forward(p, r):
        x = p["e"][r]
        s = (x @ p["q"]) @ (x @ p["k"]).transpose(0, 2, 1) / math.sqrt(w) + np.where(gap < 0, -1e9, p["near"][np.maximum(gap, 0)])
        a = language_model._softmax(s)
        o = a @ (x @ p["v"])
        h = x + o @ p["o"]
        return x, a, o, h, language_model._softmax(h @ p["u"] + p["c"])

    for factor in (1, 6):
        start = {n: (v * factor).astype(np.float32) for n, v in language_model.start_parameters().items()}
        p = {n: v.astype(float) for n, v in start.items()}
        order = np.random.default_rng(5).permutation(len(rows))[: language_model.BATCH]
        r, y = rows[order], targets[order]
        _, _, _, h, z = forward(p, r)
        z = (z - (np.arange(128) == y[..., None])) * (y >= 0)[..., None] / (y >= 0).sum()
        slope = np.einsum("bih,bic->hc", h, z)
        got = language_model.train({n: v.copy() for n, v in start.items()}, rows[order], targets[order])
        one = np.random.default_rng(5).permutation(len(order))
        assert sorted(one) == list(range(len(order))) and np.allclose(got["u"], p["u"] - language_model.RATE * slope / (abs(slope) + 1e-8), atol=2e-4)
        text = rng.integers(0, 90, language_model.SEGMENT)
        classes = np.arange(90) % 128
        *_, z = forward(p, np.concatenate([[language_model.ROWS], text[:-1], np.zeros(size - len(text), int)])[None])
        want = np.log10(z[0, np.arange(len(text)), classes[text]]).sum()
        assert math.isclose(language_model.Scorer(start, classes, np.zeros(90)).score([text])[0], want, rel_tol=1e-4)


def test_attention_scores_each_subword_once_and_sums_to_one():
    rng = np.random.default_rng(0)
    p = language_model.start_parameters()
    size = 300
    classes, share = language_model.vocabulary_classes(size, {i: i for i in range(size)})
    scorer = language_model.Scorer(p, classes, share)
    text = rng.integers(0, size, 70)
    whole = scorer.score([text, text[:33], np.zeros(0, np.int64)])
    assert np.allclose(whole[:2], [scorer.score([text])[0], scorer.score([text[:33]])[0]]) and whole[2] == 0
    next_one = np.array([scorer.score([np.append(text, i)])[0] for i in range(size)]) - whole[0]
    assert len(np.unique(classes)) == language_model.CLASSES and abs((10**next_one).sum() - 1) < 1e-3


def test_scoring_makes_few_copies_of_attention_and_logits():
    import tracemalloc

    rng = np.random.default_rng(0)
    scorer = language_model.Scorer(language_model.start_parameters(), rng.integers(0, 128, 300), np.zeros(300))
    text = rng.integers(0, 300, language_model.STEP * language_model.SEGMENT)
    tracemalloc.start()
    try:
        scorer.score([text])
        assert tracemalloc.get_traced_memory()[1] < 9 << 20  # 4 MB of logits; with copies of them it was 11 MB
    finally:
        tracemalloc.stop()


def test_training_packs_the_rows_that_windows_have():
    """Rows that no window has keep their values, and steps neither hold nor go through slopes of theirs."""
    import tracemalloc

    rng = np.random.default_rng(2)
    rows, targets = rng.integers(0, 500, (130, 64)).astype(np.int16) * 16, rng.integers(0, 128, (130, 64)).astype(np.int16)
    start = language_model.start_parameters()
    whole = {n: v.copy() for n, v in start.items()}
    tracemalloc.start()
    try:
        got = language_model.train(start, rows, targets)
        assert tracemalloc.get_traced_memory()[1] < 6e6  # with slopes, their squares and steps of all rows it was 6.4 MB
    finally:
        tracemalloc.stop()
    met = np.isin(np.arange(len(whole["e"])), rows)
    assert (got["e"][~met] == whole["e"][~met]).all() and (got["e"][met] != whole["e"][met]).any(axis=1).all() and got["e"].shape == whole["e"].shape


def test_classes_with_far_numbers_and_large_logits_score_as_they_are_written():
    rng, size = np.random.default_rng(6), language_model.SEGMENT
    p = {n: (v * (1 if n == "near" else 8)).astype(np.float32) for n, v in language_model.start_parameters().items()}
    p["c"] = rng.normal(0, 8, language_model.CLASSES).astype(np.float32)
    text, classes = rng.integers(0, 90, size), np.arange(90) % language_model.CLASSES
    x = p["e"][np.concatenate([[language_model.ROWS], text[:-1]])].astype(float)
    a = language_model._softmax(x @ p["q"] @ p["k"].T.astype(float) @ x.T / math.sqrt(language_model.WIDTH) + np.where(np.tri(size) > 0, 0, -1e9))
    z = (x + a @ x @ p["v"].astype(float) @ p["o"]) @ p["u"] + p["c"]
    want = (z[np.arange(size), classes[text]] - z.max(axis=1) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))).sum() / math.log(10)
    assert abs(z).max() > 100 and math.isclose(language_model.Scorer(p, classes, np.zeros(90)).score([text])[0], want, rel_tol=1e-4)


def test_texts_of_a_block_are_encoded_some_at_a_time(spark):
    """Copies, empty texts and more words than are put together at once."""
    texts, path = [*HARD, *[prose(i % 9, 50) for i in range(40)], None, "", prose(10, 60_000), prose(11, 60_000), prose(12, 9)], vocabulary_path("word_bpe_49k.json")
    rows = sorted((0, i, i % 3 == 0, (t or "").lower()) for i, t in enumerate(texts))
    read = language_model.indexed(spark.createDataFrame(rows, "block int, doc_id long, held_out boolean, text string").coalesce(1), 1).collect()
    known = language_model.unified(spark.createDataFrame([(r.bucket, r.block, r.own, r.words, r.n) for r in read if r.bucket is not None], "bucket int, block int, own binary, words binary, n binary").coalesce(1), path).collect()
    blocked = [(r.block, -1, None, None, r.own, r.n, r.lengths, r.ids) for r in known if r.block is not None] + [(r.block, r.place, r.doc_id, r.held_out, r.own, None, None, None) for r in read if r.bucket is None]
    frame = spark.createDataFrame(blocked, "block int, place int, doc_id long, held_out boolean, own binary, n binary, lengths binary, ids binary").coalesce(1)
    of = language_model._pieces(path)
    for r in language_model.encoded(frame, np.zeros(60_000, np.int64), 7).collect():
        if r.n_words is not None:
            own = language_model.tokens_of(texts[r.doc_id])
            assert r.n_words == len(own) and language_model._unpacked(r.ids) == np.append(np.frombuffer(b"".join(map(of, own)), np.uint32), 7).astype(np.uint16).tobytes()


def test_training_gradients_lower_the_loss():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 20, (64, 64))
    targets = (rows * 3 + 1) % 20

    def loss(p):
        h = p["e"][rows]
        a = h @ p["q"] @ (h @ p["k"]).transpose(0, 2, 1) / 4 + np.where(np.tri(64) > 0, 0, -1e9)
        z = (h + language_model._softmax(a) @ (h @ p["v"]) @ p["o"]) @ p["u"] + p["c"]
        return -np.log(language_model._softmax(z)[np.arange(64)[:, None], np.arange(64)[None, :], targets]).mean()

    p = language_model.start_parameters()
    before = loss(p)
    for _ in range(60):
        p = language_model.train(p, rows, targets)
    assert loss(p) < 0.7 * before


def test_base_scores_are_those_of_the_whole_operator_without_a_network(spark, monkeypatch):
    texts = ["one two three one", "", None, "two four  five\nfive", "Three nine"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = vocabulary_path("word_bpe_49k.json")
    whole = language_model.score(docs, path).drop("score").sort("doc_id").collect()
    monkeypatch.setattr(language_model, "_average", None)  # averaging networks would fail
    assert language_model.score(docs, path, network=False).sort("doc_id").collect() == whole

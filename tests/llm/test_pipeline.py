"""The pipeline as a whole against its parts by brute force, with hard rows and columns that clash."""

import random
import re

import corpus_pipeline
from episodica.llm import pseudonyms, quality_rules
from episodica.llm.queries import vocabulary_path

SYLLABLES = ["ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu", "pe", "ra"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, record string, matches string, score string, w string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES[:3]) for _ in range(n))


def corpus(spark, tmp_path):
    item = prose(7000, 40)
    texts = {i: prose(i, 60) for i in range(40)}
    texts |= {100: None, 101: "", 102: "few words only", 103: "again and again it says " * 30}
    texts |= {110: texts[3], 111: texts[3].upper(), 112: " ".join(prose(5, 60).split()[:-1])}
    texts |= {120: prose(900, 30) + " " + item + " " + prose(901, 30), 130: prose(950, 40) + " mail me@home.org or 31/12/2020, card 4111 1111 1111 1111", 140: prose(960, 9000)}
    rows = [(i, t, "en", "s", len(t or ""), "k", "r", "m", "v", "x") for i, t in texts.items()]
    rows += [rows[4]] * 2 + [(None, prose(999, 50), "en", "s", 1, "k", "r", "m", "v", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (*range(40), 111, 120, 130, 140)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts


def test_the_pipeline_keeps_cleans_and_encodes(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = corpus(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # Out go: no or few words, repetition, all but one of equal and near texts, the benchmark passage.
    assert set(got) - {None} == set(texts) - {100, 101, 102, 103, 110, 111, 112, 120}
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    for i, r in got.items():
        if i not in (130, None):
            assert r.ids == library.encode(texts[i], add_special_tokens=False).ids
    assert "me@home.org" not in library.decode(got[130].ids).replace(" ", "")


def test_each_stage_returns_the_columns_of_documents(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    private = corpus_pipeline.personal_data(spark, docs, str(tmp_path)).where("doc_id = 130").first()
    assert not re.search(r"me@home\.org|31/12/2020|4111 1111 1111 1111", private.text) and private.n_chars == len(private.text)
    assert corpus_pipeline.personal_data(spark, docs.where("text is null"), str(tmp_path)).first().n_chars is None
    assert pseudonyms.ROUNDS >= 8


def test_a_filter_on_the_verdict_does_not_copy_the_scoring(spark, tmp_path):
    """The optimized plan hashes as often with the filter as without."""
    corpus(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality_rules.score_documents(docs, labels)
    hashes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64")
    assert hashes(scored.where("kept").select("record.*")) <= hashes(scored) <= 8

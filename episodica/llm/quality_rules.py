"""Quality rules as a hashed n-gram importance weight, in DataFrame functions only.

Every text becomes a bag of hashed word unigrams and bigrams.  Two multinomials over the hash slots are counted:
the trusted target (documents that people labelled good) and the raw corpus (all documents).  A document's score
is the mean over its n-grams of log(target probability / raw probability); it is kept if the score reaches a fixed
threshold.  Nothing is random and nothing is sampled.

Defined cases: a null or empty text has no words, score null, and fails; null ids count in the raw corpus and never
in the target; repeated rows count as often as they occur; an empty table or no labels gives equal multinomials up
to smoothing, so scores of 0; extra columns are carried in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, words

#: Hash slots of the multinomials, and the count added to each.
SLOTS = 1 << 14
SMOOTHING = 1.0
#: Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.25
#: Characters that mark markup or tables, and the window of the repeated-words rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


def _neighbours(values: Column, distance: int) -> Column:
    """One hash for each pair of values that stand ``distance`` apart; none if there are too few."""
    n = F.greatest(F.size(values) - distance, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + distance), n), lambda a, b: F.xxhash64(a, b))


def word_hashes(column: str) -> Column:
    return F.transform(F.col(column), lambda w: F.xxhash64(w))


def multinomial_counts(texts: DataFrame, text: str) -> DataFrame:
    """``slot``, ``n``: how often each slot occurs in all whole texts."""
    hashed = texts.select(words(text_or_empty(text)).alias("w")).select(word_hashes("w").alias("h"))
    grams = hashed.select(F.concat("h", _neighbours(F.col("h"), 1)).alias("g"))
    # explode_outer: for explode, the optimizer infers a filter that would hash every text a second time.
    counts = grams.select(F.explode_outer("g").alias("g")).groupBy(F.pmod("g", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return counts.where("slot is not null")


def slot_weights(raw: DataFrame, target: DataFrame) -> Column:
    """The log ratio of every slot, in slot order, as a literal: SLOTS numbers whatever the size of the corpus.

    As a column, every row would carry a copy of them.
    """
    both = (
        raw.sparkSession.range(0, SLOTS, 1, 1)
        .select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"))
        .unionByName(raw.select("slot", F.col("n").alias("r"), F.lit(0).cast("long").alias("t")))
        .unionByName(target.select("slot", F.lit(0).cast("long").alias("r"), F.col("n").alias("t")))
        .groupBy("slot")
        .agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    )
    table = both.agg(F.array_sort(F.collect_list(F.struct("slot", "r", "t"))).alias("c"), F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    ratios = F.transform(
        "c",
        lambda c: F.log((c["t"] + SMOOTHING) / (F.col("nt") + SMOOTHING * SLOTS)) - F.log((c["r"] + SMOOTHING) / (F.col("nr") + SMOOTHING * SLOTS)),
    )
    # Doubles as text and back are the same doubles; the optimizer folds the split into one array.
    return F.split(F.lit(table.select(F.array_join(ratios.cast("array<string>"), " ")).first()[0]), " ").cast("array<double>")


def trusted_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of the documents with a label of good quality.

    A merge join at every size, since labels grow with the corpus; its shuffle can be split where an id is hot.
    """
    good = labels.where("quality = 1 and doc_id is not null").groupBy("doc_id").agg(F.lit(1).alias("one")).select(F.col("doc_id").alias("good_id"))
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(good.hint("merge"), F.col("id") == F.col("good_id")).select("text")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's variable is bound where a plain column would be copied in."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _held(df: DataFrame) -> DataFrame:
    """``df`` behind a generator: a filter on its columns stays above and copies none of the expressions that make them."""
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def covered_words(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more in ``windows``, the first occurrence too."""

    def starts(ordered: Column) -> Column:
        # In hash order, a window repeats if it equals the one before or after.
        last = F.size(ordered) - 1
        same = lambda x, k: F.get(ordered, k)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.array_compact(F.transform(ordered, lambda x, k: F.when(((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(x, F.least(k + 1, last))), x["i"]))))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Each window adds the words that the windows before it did not reach.
    return F.aggregate(
        _bound(ordered, starts),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``record`` (all columns of ``docs``), the rule counts, ``score``, ``base_failed`` and ``kept``."""
    raw = multinomial_counts(docs, text)
    target = multinomial_counts(trusted_texts(docs, labels, doc_id, text), "text")
    weights = slot_weights(raw, target)
    clean = text_or_empty(text)
    bare = clean
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # Every array that is used more than once is a column of its own, so that it is made once for each row.
    counted = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("record"),
        (F.length(clean) - F.length(bare)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        words(clean).alias("w"),
    )
    base = ("record", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    hashed = counted.select(
        "record",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        word_hashes("w").alias("h"),
    )
    pairs = hashed.select(*base, "h", _neighbours(F.col("h"), 1).alias("p"))
    fours = pairs.select(*base, "h", "p", _neighbours(F.col("p"), 2).alias("f"))
    # p: slots of the bigrams, which are the hashes of the pairs; f: hashes of the windows of eight.
    eights = fours.select(*base, F.transform(F.concat("h", "p"), lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")).alias("s"), _neighbours(F.col("f"), 4).alias("e"))
    repeated = F.when(F.size(F.array_distinct("e")) == F.size("e"), 0).otherwise(covered_words(F.col("e"))).cast("long")
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.get(weights, x))
    scored = eights.select(*base, repeated.alias("n_repeat_words"), (total / F.nullif(F.size("s"), F.lit(0))).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("score") >= threshold, F.lit(False)))
    return _held(judged)

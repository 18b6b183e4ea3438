"""Benchmark decontamination by a broadcast hash set of test n-grams.

Native: DataFrame functions only.

1. Texts are normalised (A-Z to lower case) and cut into words.  The n-grams of a benchmark item are its windows of
   ``NGRAM`` consecutive words; an item of fewer words, but not none, is one window.  They are written once, with
   their 64-bit hash, their words and their item.
2. Training texts are scanned window by window: the hashes of a text's words are one array of longs, exploded into
   windows that go straight into a semi join with the hash set, in one generated loop.  A window of ten words holds an
   inner window of six that begins at a multiple of five, so every fifth place is looked up in the set of inner windows
   first, and only around its hits are all windows looked up.  Sets are broadcast in slices of at most ``MAX_SET``
   hashes (one scan a slice, so nothing larger is ever broadcast); only hits go on, with their words and the digest of
   the text, so copies of a text are one.
3. Hits are verified: the normalised words of a hit must equal those of a benchmark window.  Overlapping hits are
   merged into spans of words, and the items whose windows occur are listed.
4. The findings join the documents by digest.  :func:`remove_spans` cuts the spans out of the texts and
   :func:`drop_contaminated` drops documents by their share of hit words.

No shuffle moves a window that does not hit, and none moves a text before the last join (whose findings Spark
broadcasts if they are small).

Defined results: a null or empty text has no words and is clean; very long texts are scanned whole (one long per
word); repeated rows of ``docs`` each get the findings of their text; repeated items count once; windows of an item
without an id hit words, but the item is not listed; an empty benchmark leaves everything clean, empty ``docs`` stay
empty; extra columns stay, whatever their names (a column named like a finding is replaced).
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import fresh, let, materialize, text_or_empty

NGRAM = 10
#: Hashes in one broadcast slice (about 64 MB as a hash table).
MAX_SET = 2_000_000

# Fixed value: a word of lower-cased text holds everything but the ASCII characters that are neither letters nor digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words in a text whose capitals are still there.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOUND = "digest binary, n_hit long, spans array<struct<first:int,past:int>>, item_ids array<string>"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of the text, capitals kept: what stands between separators, without the empty ends."""
    def inner(w: Column) -> Column:
        head, tail = (F.when(F.element_at(w, at) == "", 1).otherwise(0) for at in (1, -1))
        return F.slice(w, head + 1, F.greatest(F.size(w) - head - tail, F.lit(0)))
    return let(F.split(text_or_empty(text), SEPARATORS), inner)


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _hashes(words: Column) -> Column:
    """A hash of each word, equal for words that differ in case alone (more than A-Z count as case here: the check of
    the words comes later)."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _window_hash(size: int, at: Callable[[Column], Column]) -> Column:
    """The hash of the window of ``size`` words at ``pos``; ``at`` reads the hash of a word, and null adds nothing."""
    return F.xxhash64(*[at(F.col("pos") + k) for k in range(size)])


def _gram(size: int) -> Column:
    """The normalised words of the window at ``pos`` (fewer, if the text ends), with spaces between them."""
    return lower_ascii(F.array_join(F.slice("words", F.col("pos") + 1, F.lit(size)), " "))


def benchmark_ngrams(items: DataFrame, id_col: str = "item_id", text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """The distinct (h, size, gram, item) of all items; a gram is its words with spaces between them."""
    words = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - ngram, F.lit(0)))
    return words.where(n > 0).select("item", "words", _hashes(F.col("words")).alias("hs"), F.explode(starts).alias("pos")) \
        .select(_window_hash(ngram, lambda i: F.get("hs", i)).alias("h"), F.least(n, F.lit(ngram)).alias("size"),
                _gram(ngram).alias("gram"), "item").distinct()


def _hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(digest, pos, size, h, gram): the windows of the texts that have the hash of a benchmark window, with their words."""
    parts = []
    n, word = F.size("hs"), (lambda i: F.col("hs")[i])
    for row in grams.groupBy("size").agg(F.count_distinct("h").alias("n")).orderBy("size").collect():
        size = row["size"]
        step = max(1, size // 2)
        inner = size - step + 1
        own = grams.filter(F.col("size") == size)
        # every window of a benchmark item holds, at one of its first ``step`` places, an inner window
        inners = own.select(_hashes(F.split("gram", " ")).alias("hs"),
                            F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("pos")) \
            .select(_window_hash(inner, word).alias("h")).distinct()
        slices = max(1, -(-row["n"] * step // MAX_SET))
        # the arrays of a text stay where they are; exploded rows refer to them inside one generated loop
        texts = docs.select("digest", words_of(F.col("text")).alias("words"))
        texts = texts.select("digest", "words", _hashes(F.col("words")).alias("hs"))
        # the outer form: for the other one Spark adds a test of the array below, which would cut each text twice
        every = F.when(n >= size, F.sequence(F.lit(0), n - inner, F.lit(step)))
        places = texts.select("digest", "words", "hs", F.explode_outer(every).alias("pos")).where("pos is not null")
        places = places.withColumn("inner", _window_hash(inner, word))
        hashes = own.select("h").distinct()
        hashes = F.broadcast(hashes) if row["n"] <= MAX_SET else hashes
        for k in range(slices):
            held = inners.filter(F.pmod("h", F.lit(slices)) == k) if slices > 1 else inners
            held = held.withColumnRenamed("h", "inner")
            near = places.join(F.broadcast(held), "inner", "left_semi")
            around = F.sequence(F.greatest(F.col("pos") - (step - 1), F.lit(0)), F.least(F.col("pos"), n - size))
            windows = near.select("digest", "words", "hs", F.explode(around).alias("pos")).withColumn("h", _window_hash(size, word))
            parts.append(windows.join(hashes, "h", "left_semi")
                         .select("digest", "pos", F.lit(size).alias("size"), "h", _gram(size).alias("gram")))
    return reduce(DataFrame.union, parts)


def findings(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id",
             item_text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(digest, n_hit, spans, item_ids) of every contaminated text; spans are [first, past) in words, in order."""
    spark = docs.sparkSession
    grams = materialize(benchmark_ngrams(items, id_col, item_text_col, ngram), "benchmark-ngrams")
    if grams.isEmpty():
        return spark.createDataFrame([], _FOUND)
    text = F.col(f"`{text_col}`")
    texts = docs.select(digest_of(text).alias("digest"), text.alias("text"))
    hits = _hits(texts, grams).distinct()
    exact = materialize(hits.join(grams.select("h", "gram").distinct(), ["h", "gram"], "left_semi"), "benchmark-exact")

    by_place = Window.partitionBy("digest").orderBy("pos", "size")
    before = F.max(F.col("pos") + F.col("size")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = exact.select("digest", "pos", "size", before.alias("before"))
    starts = F.when(F.col("before").isNull() | (F.col("pos") > F.col("before")), 1).otherwise(0)
    runs = runs.withColumn("run", F.sum(starts).over(by_place))
    spans = runs.groupBy("digest", "run").agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("size")).alias("past")) \
        .groupBy("digest").agg(F.sum(F.col("past") - F.col("first")).cast("long").alias("n_hit"),
                               F.array_sort(F.collect_list(F.struct("first", "past"))).alias("spans"))
    listed = exact.select("digest", "h", "gram").distinct().join(grams.select("h", "gram", "item"), ["h", "gram"]) \
        .filter(F.col("item").isNotNull()).groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    out = spans.join(listed, "digest", "left")
    return materialize(out.select("digest", "n_hit", "spans", F.coalesce("item_ids", F.array().cast("array<string>"))
                                  .alias("item_ids")), "benchmark-found")


def _joined(docs: DataFrame, items: DataFrame, text_col: str, **names) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the findings of their texts, under names that no column of ``docs`` has."""
    found = findings(docs, items, text_col, **names)
    new = {c: fresh(docs.columns, f"{c}__") for c in found.columns}
    return docs.withColumn(new["digest"], digest_of(F.col(f"`{text_col}`"))) \
        .join(found.select(*[F.col(c).alias(n) for c, n in new.items()]), new["digest"], "left").drop(new["digest"]), new


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` with n_words, n_hit, spans and item_ids."""
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "spans", "item_ids")]
    count = fresh(docs.columns, "n_words__")
    # counted below the join: a caller that leaves the texts out moves none
    out, new = _joined(docs.withColumn(count, count_words(F.col(f"`{text_col}`"))), items, text_col, **names)
    none = F.array().cast("array<struct<first:int,past:int>>")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(count).alias("n_words"),
                      F.coalesce(new["n_hit"], F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce(new["spans"], none).alias("spans"),
                      F.coalesce(new["item_ids"], F.array().cast("array<string>")).alias("item_ids"))


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the hit words, each with what stands between it and the word before; other texts stay as they are."""
    out, new = _joined(docs, items, text_col, **names)
    text, spans = F.col(f"`{text_col}`"), F.col(f"`{new['spans']}`")
    between, word = SEPARATORS[:-1] + "*", SEPARATORS.replace("[", "[^")

    def cut(tokens: Column) -> Column:
        first = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["past"]))
        past = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(tokens)))
        kept = F.flatten(F.zip_with(first, past, lambda a, b: F.slice(tokens, a + 1, b - a)))
        return F.concat(F.array_join(kept, ""), F.regexp_extract(text, between + r"\z", 0))

    clean = F.when(spans.isNull(), text).otherwise(
        let(F.regexp_extract_all(text, F.lit(between + word), F.lit(0)), cut))
    return out.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", max_share: float = 0.0,
                      **names) -> DataFrame:
    """``docs`` without the documents whose hit words are more than ``max_share`` of their words."""
    out, new = _joined(docs, items, text_col, **names)
    hit = F.coalesce(new["n_hit"], F.lit(0).cast("long"))
    return out.filter(hit <= max_share * count_words(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_sql(ngram: int = NGRAM) -> str:
    """DuckDB SQL for doc_id, n_words, n_hit, n_items, items_sha256, contaminated of ``documents`` against ``benchmark``."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), {ngram}) AS size, array_to_string(w[i:i + least(len(w), {ngram}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {ngram}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM g),
win AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)),
hit AS (SELECT rid, i, win.size, item_id FROM win JOIN g USING (size, gram)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

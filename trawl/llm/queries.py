"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.bpe import encode_documents
from trawl.llm.common import table
from trawl.llm.conversation_repair import damage, repair_report
from trawl.llm.decontaminate import contamination, decontamination_sql
from trawl.llm.hard_negatives import hard_negatives
from trawl.llm.mixing import with_probability
from trawl.llm.mixing_sql import mixing_sql
from trawl.llm.permutation_index import nearest
from trawl.llm.pii import pseudonymize
from trawl.llm.quality_rules import (COVERED, COVERED_LETTERS, LANG_CODE, MAX_REPEAT_PERCENT, MIN_OTHER_LETTERS,
                                     MIN_REPEATED_SHORT, MIN_WORDS, RULES, SHORT, STOP_WORDS, WINDOW, quality_rules)
from trawl.llm.quality_net import quality_scores
from trawl.llm.secrets import find_secrets
from trawl.llm.simhash import fingerprint_hex, near_duplicates
from trawl.llm.site_templates import main_text
from trawl.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under the threshold table."""
    return quality_rules(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    """The threshold table as a SQL condition over the measures of the CTE ``m``."""
    parts = [f"({r.measure} >= {r.low}{' OR uncovered' if r.measure == 'stop_words_per_word' else ''})"
             for r in RULES if r.low is not None]
    parts += [f"{r.measure} <= {r.high}" for r in RULES if r.high is not None]
    return " AND ".join(parts)


_COVERED = ", ".join(f"'{c}'" for c in COVERED)
_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
ORACLES["op5_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract(lower(coalesce(lang, '')), '{LANG_CODE}', 1) AS code,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM d WHERE len(words) >= {WINDOW})),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(i - p, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM dup) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(lines)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
         len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS n_stop, code,
         length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters,
         length(regexp_replace(t, '\\P{{L}}+|[{COVERED_LETTERS}]+', '', 'g')) AS other,
         list_transform(words, lambda w: lower(w)) AS low
  FROM d LEFT JOIN rep USING (doc_id)),
u AS (
  SELECT *, list_filter(list_filter(low, lambda w, i: i = 1 OR w <> low[i - 1]), lambda w: regexp_matches(w, '{SHORT}')) AS short
  FROM c),
m AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_bangs / greatest(n_words, 1) AS bangs_per_word, n_stop / greatest(n_words, 1) AS stop_words_per_word,
         n_dup_lines / greatest(n_lines, 1) AS dup_lines_per_line,
         n_repeat_words / greatest(n_words, 1) AS repeat_words_per_word,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CASE WHEN code IN ({_COVERED}) THEN false WHEN code <> '' THEN true
              ELSE letters > 0 AND (other >= {MIN_OTHER_LETTERS} * letters
                   OR len(short) - len(list_distinct(short)) >= {MIN_REPEATED_SHORT} * n_words) END AS uncovered
  FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules_sql()} AS kept
FROM m
"""
QUERIES["op5_quality_rules"] = op5_quality_rules


def op6_simhash_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


QUERIES["op6_simhash_vantage_trees"] = op6_simhash_vantage_trees


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of mentions replaced."""
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_mentions")
    return out.select("doc_id", "text", "n_mentions")


def op7_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, tokens, probability and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = with_probability(docs)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"),
                      "sampled")


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the decoded text."""
    return encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES["op1_pii_surrogates"] = op1_pii_surrogates
QUERIES["op7_mixing_weights"] = op7_mixing_weights
QUERIES["op9_bpe_automaton"] = op9_bpe_automaton


def op2_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op8_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES["op2_quality_network"] = op2_quality_network
QUERIES["op3_secret_markov"] = op3_secret_markov
QUERIES["op4_site_templates"] = op4_site_templates
QUERIES["op8_toxicity_counterfactual"] = op8_toxicity_counterfactual
QUERIES["op10_permutation_index"] = op10_permutation_index
ORACLES["op7_mixing_weights"] = mixing_sql()


def op12_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items these are from."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


QUERIES["op12_ngram_decontamination"] = op12_ngram_decontamination
ORACLES["op12_ngram_decontamination"] = decontamination_sql()


def op13_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (a vector whose id is divisible by 100) and positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("ids") % 100 == 0, label=label)


QUERIES["op13_gnat_hard_negatives"] = op13_gnat_hard_negatives
ORACLES["op13_gnat_hard_negatives"] = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, s AS negative_score,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id)::INTEGER AS rank
FROM pos JOIN p USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY rank <= 10
"""


def op11_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage of its rows."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damage(conversations))


QUERIES["op11_grammar_repair"] = op11_grammar_repair

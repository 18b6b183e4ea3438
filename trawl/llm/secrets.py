"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Only DataFrame functions: no Python, pandas or Arrow code runs on the executors.

*Base* spans are the matches of three patterns.  The *Markov* spans come from the other runs of ``MIN_RUN`` or more
characters of the alphabet of keys: a run is a secret if a first-order character model of random strings explains it
better than one of ordinary identifiers by ``MIN_RATIO`` nats in total and ``MIN_PER_CHAR`` per transition.  Both
models are counted from labelled samples (:func:`labelled_samples` makes them from the documents: their words and
names joined from two words against the random parts of base matches and digests of ids), on at most
``SAMPLE_DOCS`` documents, and smoothed; the model is a table of alphabet x alphabet numbers, whatever the input.

Positions: Spark has no function for match positions, but splitting a text at a pattern gives the gaps between the
matches, and gaps and matches in turn add up to code point offsets.

Defined results: a null or empty text has no spans and the digest of the empty text; repeated rows are scanned one by
one; a text far longer than others is still one row of one task (the work is linear in its length, and quadratic
only in the number of its spans); extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import bounded_sample, let, text_or_empty

# The base patterns (the length conditions of access and hex are part of the pattern: a maximal run
# that is too short holds no longer one).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

MIN_RUN = 16
RUN = f"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
#: Documents that the models are counted on (smallest id hash first), and characters of one sample.
SAMPLE_DOCS = 1_000
SAMPLE_CHARS = 64
SMOOTHING = 0.5
MIN_RATIO = 12.0
MIN_PER_CHAR = 0.6
LOW, HIGH = 43, 122  # code points of "+" and "z": the alphabet of runs lies between
WIDTH = HIGH - LOW + 1
SPANS = "array<struct<start: int, kind: int, end: int>>"


def spans_of(text: Column, pattern: str, kind: int, good=None) -> Column:
    """The spans of the leftmost non-overlapping matches, in code points; ``good(match, number)`` may drop some."""
    def walk(gaps: Column, matches: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["g"])
            end = start + F.length(pair["m"])
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(pair["ok"], F.concat(acc["out"], one)).otherwise(acc["out"])
                            .alias("out"))
        ok = good(matches) if good else F.transform(matches, lambda m: F.lit(True))
        pairs = F.zip_with(F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m")), ok,
                           lambda p, o: F.struct(p["g"].alias("g"), p["m"].alias("m"), o.alias("ok")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda m: let(F.split(text, pattern, -1), lambda g: walk(g, m)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """The spans of the three base kinds."""
    def long_enough(matches: Column) -> Column:
        values = F.transform(matches, lambda m: F.regexp_extract(m, ASSIGN, 2))
        return F.transform(values, lambda v: F.length(v) >= ASSIGN_MIN)
    return spans_of(text, ASSIGN, 0, long_enough), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)


# --- the two character models ----------------------------------------------------------------------------------------

def labelled_samples(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(sample, random): ordinary identifiers (0) and random strings (1) from at most ``most`` documents."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"),
                    text_or_empty("text").alias("t"))
    d = bounded_sample(d, F.col("id"), docs.count(), most)
    plain = F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    d = d.select("id", "t", F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    after = F.slice("w", 2, F.size("w"))
    joined = [F.zip_with("w", after, lambda a, b: F.concat_ws("_", F.lower(a), F.lower(b))),
              F.zip_with("w", after, lambda a, b: F.concat(F.lower(a), F.initcap(F.coalesce(b, F.lit(""))))),
              F.zip_with("w", after, lambda a, b: F.concat_ws("-", F.lower(a), F.lower(b))),
              F.zip_with("w", after, lambda a, b: F.concat_ws("_", F.upper(a), F.upper(b))),
              F.zip_with("w", after, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))]
    # numbers are ordinary: ids, amounts, account and telephone numbers are not keys
    numbers = F.transform("w", lambda x: F.abs(F.xxhash64(x) % 10 ** 16).cast("string"))
    ordinary = d.select(F.explode(F.concat(F.col("w"), numbers, *joined)).alias("sample"), F.lit(0).alias("random"))
    digest = F.sha2(F.concat(F.lit("sample "), "id"), 256)
    made = d.select(F.explode(F.array(
        digest, F.upper(digest), F.translate(F.base64(F.unhex(digest)), "=", ""),
        F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 512))), "[^A-Za-z0-9]", ""),
        F.regexp_replace(F.upper(F.base64(F.unhex(F.sha2(digest, 384)))), "[^A-Z0-9]", ""))).alias("sample"),
        F.lit(1).alias("random"))
    matched = d.select(F.explode(F.concat(
        F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))).alias("sample"), F.lit(1).alias("random"))
    return ordinary.unionByName(made).unionByName(matched)


def log_ratios(samples: DataFrame) -> list[float]:
    """log P(next | previous, random) - log P(next | previous, ordinary) for all pairs of characters.

    The counts come back as at most 2 * WIDTH * WIDTH rows.  The two chances are mixed with a uniform one
    (``SMOOTHING`` a pair), so a model without samples is uniform.
    """
    chars = samples.select("random", F.split(F.substring("sample", 1, SAMPLE_CHARS), "").alias("c"))
    pairs = chars.select("random", F.explode(F.zip_with(
        "c", F.slice("c", 2, F.size("c")),
        lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))).alias("p")) \
        .select("random", "p.a", "p.b").filter(f"a between {LOW} and {HIGH} and b between {LOW} and {HIGH}")
    counts = [[[SMOOTHING] * WIDTH for _ in range(WIDTH)] for _ in range(2)]
    for r in pairs.groupBy("random", "a", "b").count().collect():
        counts[r["random"]][r["a"] - LOW][r["b"] - LOW] += r["count"]
    out = []
    for a in range(WIDTH):
        both = [[math.log(n / sum(model[a])) for n in model[a]] for model in counts]
        out += [both[1][b] - both[0][b] for b in range(WIDTH)]
    return out


def ratio(run: Column, table: Column) -> Column:
    """The log-likelihood ratio of a run, a sum over its transitions."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - LOW)
    steps = let(codes, lambda c: F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.get(table, a * WIDTH + b)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts and digest, and all spans."""
    # one literal, parsed once when the plan is made
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def secret(runs: Column) -> Column:
        return F.transform(runs, lambda r: let(ratio(r, table), lambda s: (s >= MIN_RATIO)
                                               & (s >= MIN_PER_CHAR * (F.length(r) - 1))))

    text = text_or_empty(f"`{text_col}`")
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    assign, access, hexes = base_spans(F.col("t"))
    df = df.select("doc_id", "t", assign.alias("assign"), access.alias("access"), hexes.alias("hex"),
                   F.regexp_extract_all("t", F.lit(RUN), F.lit(0)).alias("runs"))
    df = df.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    any_secret = F.exists(secret(F.col("runs")), lambda x: x)
    found = F.when(any_secret, spans_of(F.col("t"), RUN, 3, secret)).otherwise(F.array().cast(SPANS))
    df = df.withColumn("markov", found)
    # a run that touches a base span adds nothing
    added = F.filter("markov", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    df = df.withColumn("added", added)

    def written(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return df.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Fit both models to labelled samples (made from the documents, if none are given) and scan every document."""
    return scan(docs, log_ratios(labelled_samples(docs) if samples is None else samples))

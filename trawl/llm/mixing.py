"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Only DataFrame functions: no Python, pandas or Arrow code runs on the executors.

1. One pass over the documents counts the tokens (words) of every (source, language, topic) cell.  The table is kept
   with one row per source and the list of its cells (language, topic, tokens); sources may be many, and so may
   languages: a list is as long as the pairs that its source has, and the driver holds one number per pair.
2. Raking: a cell's weight is ``a[source] * b[language] * c[topic]`` times its tokens.  For given ``b`` and ``c`` the
   source factor follows in the row itself (``a = target / sum``), so a whole cycle is one aggregate over the cells
   that returns one number per pair; the language and topic factors are updated from these numbers.
   Cycles end when all three marginals meet their targets within ``TOLERANCE``.  Tables that come near slowly (most
   sources have almost one language only) are extrapolated from the last cycles (Anderson's method on the logarithms
   of the factors, with a plain cycle wherever the error grows).
3. Calibration: a document is drawn with probability ``min(1, scale * a * b * c)``; ``scale`` is solved so that the
   expected number of tokens drawn is ``keep`` times all tokens (a few more aggregates over the source table).
4. Sampling: the decision compares the probability with a uniform number made from the document id, so it is the
   same whenever a lost task is computed again.

A hot source costs partial sums only.  The factor tables are joined to the documents by source and by language; Spark
broadcasts them where their size on disk is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise splits hot keys.

Defined results: a null source or language is a category of its own; a null or word-less text has no tokens and
probability 0; targets of categories that have no tokens are dropped and the rest scaled to 1; targets that the
cells provably cannot meet end when the cycles come no nearer, with the fit found so far; a fit that does not meet its
targets is logged as a warning; repeated rows share one decision; an empty table gives an empty result; other columns
pass through.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import fresh, materialize, text_or_empty

# A topic is the first of these whose marks a text contains.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("legal", ("License", "license", "Copyright", "copyright")),
    ("tabular", (" | ",)),
    ("contact", ("@", "+1 (")),
    ("prose", ()),
)
MARGINS = ("source", "lang", "topic")
#: Default targets: each category's share of the tokens to this power (1: as found, 0: all equal).
ALPHA = 0.5
#: Expected share of all tokens that is drawn.
KEEP = 0.3
TOLERANCE = 1e-9
MAX_CYCLES = 200
#: Cycles of the raking, before an unmet fit is reported.
MAX_RAKING = 5_000
#: Plain cycles before extrapolation; also those in which the error of targets that cannot be met must fall to a third.
STALL = 20
#: Earlier cycles that an extrapolation uses, and the largest change of a logarithm in one.
MEMORY = 5
MAX_STEP = 5.0
NONE = "(none)"


def token_count(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    out = F.lit(TOPICS[-1][0])
    for name, marks in reversed(TOPICS[:-1]):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, name).otherwise(out)
    return out


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) made from the id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _targets(found: dict[str, float], wanted: dict[str, float] | None, alpha: float) -> dict[str, float]:
    """Targets of the categories that have tokens, scaled to 1."""
    seen = {k: v for k, v in found.items() if v > 0}
    raw = {k: wanted.get(k, 0.0) for k in seen} if wanted else {k: v ** alpha for k, v in seen.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total > 0 else dict.fromkeys(seen, 1 / max(1, len(seen)))


def _numbers(values: list[float | None]) -> Column:
    """An array of doubles (NaN for None) as one literal that the optimizer folds: it stays out of the generated code,
    which is compiled once for all cycles."""
    return F.split(F.lit(",".join("NaN" if v is None else repr(float(v)) for v in values or [None])), ",").cast("array<double>")


class Raking:
    """The fitted mixture: a factor per source (a table), per language (a table and a list) and per topic."""

    def __init__(self, sources: DataFrame, langs: DataFrame, lang_weights: dict[str, float],
                 topic_weights: dict[str, float], scale: float, cycles: int, error: float, pairs: list[tuple[str, str]]):
        self.sources, self.langs, self.lang_weights, self.topic_weights = sources, langs, lang_weights, topic_weights
        self.scale, self.cycles, self.error, self.pairs = scale, cycles, error, pairs

    @property
    def weights(self) -> list[float]:
        """The factors of ``pairs``."""
        return [self.lang_weights[lang] * self.topic_weights[topic] for lang, topic in self.pairs]


def rake(tokens: DataFrame, source_targets: dict[str, float] | None = None,
         lang_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None,
         alpha: float = ALPHA, keep: float = KEEP) -> Raking:
    """Fit the factors to a table (source, lang, topic, n_tokens)."""
    cells = materialize(tokens.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("n"))
                        .filter("n > 0"), "mix-cells")
    numbered = {}
    for col in ("lang", "topic"):       # one row per category
        numbered[col] = materialize(cells.select(col).distinct().withColumn(
            f"{col}_at", F.row_number().over(Window.orderBy(col)) - 1), f"mix-{col}s")
    named = {col: [r[0] for r in numbered[col].orderBy(f"{col}_at").collect()] for col in numbered}
    pairs_n = {(r["lang"], r["topic"]): r["n"] for r in cells.groupBy("lang", "topic").agg(F.sum("n").alias("n")).collect()}
    pairs, total = sorted(pairs_n), sum(pairs_n.values())

    def margin(at: int) -> dict[str, float]:
        out: dict[str, float] = {}
        for p, n in pairs_n.items():
            out[p[at]] = out.get(p[at], 0.0) + n
        return out

    want = [_targets(margin(0), lang_targets, alpha), _targets(margin(1), topic_targets, alpha)]
    wide = cells.join(numbered["lang"], "lang").join(numbered["topic"], "topic").groupBy("source").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("lang_at", "topic_at", "n")).alias("cells"))
    if source_targets:
        given = F.create_map(*[x for k, v in source_targets.items() for x in (F.lit(k), F.lit(float(v)))])
        raw = F.coalesce(given[F.col("source")], F.lit(0.0))
    else:
        raw = F.pow("all", F.lit(alpha))
    wide = materialize(wide.withColumn("raw", raw), "mix-sources")
    raw_total = wide.agg(F.sum("raw")).first()[0] or 1.0
    wide = wide.withColumn("target", F.col("raw") / raw_total)

    def of_cell(values: tuple[list, list]) -> Callable[[Column], tuple[Column, Column]]:
        """The language's and the topic's number of a cell."""
        langs, topics = _numbers(values[0]), _numbers(values[1])
        return lambda c: (F.get(langs, c["lang_at"]), F.get(topics, c["topic_at"]))

    def factor(values: tuple[list, list]) -> Column:
        """The factor of a source that meets its target under the language and topic factors."""
        look = of_cell(values)

        def part(c: Column) -> Column:
            lang, topic = look(c)
            return c["n"] * (lang * topic)
        dot = F.aggregate(F.transform("cells", part), F.lit(0.0), lambda s, x: s + x)
        return F.when(dot > 0, F.col("target") / dot).otherwise(0.0)

    # logarithms of the language and topic factors; categories whose target is 0 have the weight 0
    live = [(at, k) for at in (0, 1) for k in sorted(want[at]) if want[at][k] > 0]
    place = {c: i for i, c in enumerate(live)}
    goal = np.array([want[at][k] for at, k in live])

    def spread(x: np.ndarray) -> tuple[list, list]:
        """A vector over the live categories as a list per margin (None: the category's target is 0)."""
        return tuple([float(x[place[at, k]]) if (at, k) in place else None for k in named[c]] for at, c in enumerate(named))

    def powers(x: np.ndarray) -> tuple[list, list]:
        return tuple([0.0 if v is None else math.exp(min(v, 350.0)) for v in part] for part in spread(x))

    def gain(step: np.ndarray) -> Column:
        """What a change of the logarithms must cost a source at least."""
        look = of_cell(spread(step))

        def sum_of(c: Column) -> Column:
            lang, topic = look(c)
            return F.when(~F.isnan(lang + topic), lang + topic)
        best = F.array_max(F.transform("cells", sum_of))
        return F.when(F.col("target") > 0, F.col("target") * F.coalesce(best, F.lit(-1e300))).otherwise(0.0)

    def sums(x: np.ndarray, step: np.ndarray) -> tuple[list[float], float]:
        """The sum of source factor x tokens of each pair, and the cost of ``step``: one aggregate."""
        none = F.lit(-1)
        parts = F.concat(F.transform("cells", lambda c: F.struct(c["lang_at"].alias("l"), c["topic_at"].alias("t"),
                                                                 (F.col("a") * c["n"]).alias("v"))),
                         F.array(F.struct(none.alias("l"), none.alias("t"), gain(step).alias("v"))))
        got = wide.withColumn("a", factor(powers(x))).select(F.explode(parts).alias("p")) \
            .groupBy("p.l", "p.t").agg(F.sum("p.v").alias("v")).collect()
        found = {(r["l"], r["t"]): r["v"] for r in got}
        where = [{k: i for i, k in enumerate(named[c])} for c in named]
        return [found[where[0][lg], where[1][tp]] for lg, tp in pairs], found[-1, -1]

    cycles, error, errors, impossible = 0, 0.0, [], False
    x, step = np.zeros(len(live)), np.zeros(len(live))
    points: list[tuple[np.ndarray, np.ndarray]] = []
    nearest: tuple[float, np.ndarray] | None = None
    while pairs and cycles < MAX_RAKING:
        rows, cost = sums(x, step)
        by_lang, by_topic = (dict(zip(named[c], part)) for c, part in zip(named, powers(x)))
        mass = [m * by_lang[lg] * by_topic[tp] for m, (lg, tp) in zip(rows, pairs)]
        # no factors meet the targets if some change of their logarithms gains without bound (Farkas)
        impossible = impossible or float(goal @ step) - (cost or 0.0) > 1e-9 * float(np.abs(step).max(initial=0.0))
        error, step = 0.0, np.zeros(len(live))
        for at, target in enumerate(want):
            now: dict[str, float] = {}
            for p, m in zip(pairs, mass):
                now[p[at]] = now.get(p[at], 0.0) + m
            error = max([error, *(abs(now[k] - target.get(k, 0.0)) for k in now)])
            ratio = {k: target.get(k, 0.0) / v if v > 0 else 0.0 for k, v in now.items()}
            mass = [m * ratio[p[at]] for p, m in zip(pairs, mass)]
            for k in now:
                if (at, k) in place and ratio[k] > 0:
                    step[place[at, k]] = math.log(ratio[k])
                elif (at, k) in place:
                    impossible = True  # no source reaches it
        cycles += 1
        errors.append(error)
        # met; or the targets contradict the empty cells, and cycles no longer come nearer
        if error <= TOLERANCE or impossible and cycles > STALL and error > 0.3 * errors[-1 - STALL]:
            x = x + step
            break
        if cycles <= STALL or impossible:
            x = x + step
            continue
        if nearest is not None and error > 2 * nearest[0]:
            points, x, nearest = [], nearest[1], None  # extrapolated too far: a plain cycle from the nearest point
            continue
        if nearest is None or error < nearest[0]:
            nearest = error, x + step
        points = [*points, (x, step)][-1 - MEMORY:]
        move = step
        if len(points) > 1:
            dx = np.diff([q for q, _ in points], axis=0).T
            ds = np.diff([q for _, q in points], axis=0).T
            move = step - (dx + ds) @ np.linalg.lstsq(ds, step, rcond=1e-12)[0]
            if not np.all(np.abs(move) <= MAX_STEP):
                points, move = [], step
        x = x + move
    if cycles == MAX_RAKING and error > TOLERANCE and nearest is not None:
        error, x = nearest
    if error > TOLERANCE:
        logging.getLogger(__name__).warning("targets unmet by %.3g after %d cycles%s", error, cycles,
                                            ": the cells cannot meet them" if impossible else "")
    final = powers(x)
    fitted = materialize(wide.withColumn("a", factor(final)), "mix-factors")
    langs = materialize(numbered["lang"].select("lang", F.get(_numbers(final[0]), F.col("lang_at")).alias("b")), "mix-lang-factors")

    # scale: tokens of cells whose probability reaches 1 are spent in full, the others in proportion
    look = of_cell(final)

    def rated(c: Column) -> Column:
        lang, topic = look(c)
        return F.struct(c["n"].alias("n"), (F.col("a") * (lang * topic)).alias("w"))

    rates = fitted.select(F.transform("cells", rated).alias("rates"))
    scale, budget = 1.0, keep * total
    for _ in range(MAX_CYCLES if pairs else 0):
        by = F.lit(scale)
        full = F.aggregate("rates", F.lit(0.0), lambda s, r: s + F.when(r["w"] * by >= 1, r["n"]).otherwise(0.0))
        part = F.aggregate("rates", F.lit(0.0), lambda s, r: s + F.when(r["w"] * by < 1, r["n"] * (r["w"] * by)).otherwise(0.0))
        spent, open_ = rates.agg(F.sum(full), F.sum(part)).first()
        if not open_ or budget <= spent:
            if not spent or budget >= spent:
                break
            scale *= 0.5  # too much spent in full: start lower
            continue
        new = scale * (budget - spent) / open_
        if abs(new - scale) <= 1e-12 * scale:
            break
        scale = new
    weights = [dict(zip(named[c], part)) for c, part in zip(named, final)]
    return Raking(fitted.select("source", "a"), langs, *weights, scale, cycles, error, pairs)


def with_probability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     lang_col: str = "lang", seed: int = 17, names: tuple[str, ...] = ("topic", "n_tokens",
                                                                                  "probability", "sampled"),
                     **targets) -> DataFrame:
    """``docs`` with the topic, the tokens, the probability and the decision of each row (columns ``names``)."""
    topic, n_tokens, probability, sampled = names
    text = text_or_empty(f"`{text_col}`")
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE))
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE))
    fit = rake(docs.select(source.alias("source"), lang.alias("lang"), topic_of(text).alias("topic"),
                           token_count(text).alias("n_tokens")), **targets)
    taken = [*docs.columns, *names]
    key, a, lang_key, b = (fresh(taken, x) for x in ("source_key__", "factor__", "lang_key__", "lang_factor__"))
    df = docs.withColumns({key: source, lang_key: lang, topic: topic_of(text), n_tokens: token_count(text)})
    df = df.join(fit.langs.select(F.col("lang").alias(lang_key), F.col("b").alias(b)), lang_key, "left")
    df = df.join(fit.sources.select(F.col("source").alias(key), F.col("a").alias(a)), key, "left")
    topic_weight = F.lit(0.0)
    for tp, w in fit.topic_weights.items():
        topic_weight = F.when(F.col(topic) == tp, F.lit(w)).otherwise(topic_weight)
    pair_weight = F.coalesce(F.col(b), F.lit(0.0)) * topic_weight
    p = F.least(F.lit(1.0), F.lit(fit.scale) * F.coalesce(F.col(a), F.lit(0.0)) * pair_weight)
    df = df.withColumn(probability, F.when(F.col(n_tokens) > 0, p).otherwise(0.0))
    df = df.withColumn(sampled, uniform(F.col(f"`{id_col}`"), seed) < F.col(probability))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], *names)


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with their columns."""
    names = tuple(fresh(docs.columns, f"{x}__mix") for x in ("topic", "n_tokens", "probability", "sampled"))
    return with_probability(docs, names=names, **options).filter(F.col(names[-1])) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])

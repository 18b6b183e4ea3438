"""The SQL twin of the mixing query: the raking and calibration cycles written out as CTEs over the cell table."""

from __future__ import annotations

from trawl.llm.mixing import ALPHA, KEEP, NONE, TOPICS

CYCLES = 40
SCALE_STEPS = 12


def _topic_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(t, '{m}')" for m in marks) + f" THEN '{name}'"
                     for name, marks in TOPICS[:-1])
    return f"CASE {cases} ELSE '{TOPICS[-1][0]}' END"


def mixing_sql(seed: int = 17) -> str:
    ctes = [f"""d AS MATERIALIZED (
  SELECT doc_id, source, lang, {_topic_sql()} AS topic,
         len(list_filter(regexp_split_to_array(t, '[ \\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens
  FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang
        FROM documents))""",
            """c0 AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n, sum(n_tokens)::DOUBLE AS m FROM d
  GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for col in ("source", "lang", "topic"):
        ctes.append(f"""t_{col} AS MATERIALIZED (
  SELECT {col}, power(n, {ALPHA}) / sum(power(n, {ALPHA})) OVER () AS target
  FROM (SELECT {col}, sum(n) AS n FROM c0 GROUP BY {col}))""")
    k = 0
    for _ in range(CYCLES):
        for col in ("source", "lang", "topic"):
            ctes.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT source, lang, topic, n, m * target / sum(m) OVER (PARTITION BY {col}) AS m FROM c{k} JOIN t_{col} USING ({col}))""")
            k += 1
    # the weight of a token, scaled so that the least step starts below every cap
    ctes.append(f"r AS MATERIALIZED (SELECT source, lang, topic, n, m / n AS w FROM c{k})")
    ctes.append(f"b AS MATERIALIZED (SELECT {KEEP} * sum(n) AS budget FROM r)")
    ctes.append("s0 AS MATERIALIZED (SELECT budget / sum(n * w) AS scale FROM r, b GROUP BY budget)")
    for j in range(SCALE_STEPS):
        ctes.append(f"""s{j + 1} AS MATERIALIZED (
  SELECT any_value(scale) * (any_value(budget) - coalesce(sum(n) FILTER (WHERE w * scale >= 1), 0))
         / sum(n * w * scale) FILTER (WHERE w * scale < 1) AS scale FROM r, b, s{j})""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < p AS sampled
FROM (SELECT d.doc_id, d.source, d.lang, d.topic, n_tokens,
             CASE WHEN n_tokens > 0 THEN least(1.0, coalesce(w, 0) * scale) ELSE 0.0 END AS p
      FROM d LEFT JOIN r ON r.source = d.source AND r.lang = d.lang AND r.topic = d.topic, s{SCALE_STEPS})
"""

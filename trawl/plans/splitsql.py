"""The recursive splitter (T7) as DuckDB SQL: separators, greedy merging and overlap, independent of the Python code.

Every separator is one level.  A text in which the level's separator occurs is cut before each match (but not at its
beginning); pieces longer than the size go to the next level, and runs of the others are merged.  Merging is a recursive
step over the sums of the lengths: a chunk takes as many pieces as fit, and the next one starts at the first piece from
which no more than the overlap is left, and which leaves room for the piece that did not fit.
"""

from __future__ import annotations

from trawl.operators.chunks import MARKDOWN_SEPARATORS

_MARK = "chr(1)"


def split_sql(size: int, overlap: int, start: int = 0, table: str = "documents", key: str = "doc_id") -> str:
    """(key, chunk_number, chunk_text) of every text of ``table``."""
    ctes = [f"in0 as (select {key}, [0] as path, text as t from {table} where text is not null)"]
    last = len(MARKDOWN_SEPARATORS) - 1
    for k, sep in enumerate(MARKDOWN_SEPARATORS):
        has = "true" if sep == "" else f"regexp_matches(t, '{sep}')"
        cut = "string_split(t, '')" if sep == "" else f"string_split(regexp_replace(t, '({sep})', {_MARK} || '\\1', 'g'), {_MARK})"
        ctes.append(f"""p{k} as (
  select {key}, path, i, pieces[i] as piece, length(pieces[i]) > {size} as long
  from (select {key}, path, pieces, unnest(range(1, len(pieces) + 1)) as i
        from (select {key}, path, list_filter({cut}, lambda x: x <> '') as pieces from in{k} where {has})))""")
        ctes.append(f"""s{k} as (
  select *, sum(length(piece)) over (partition by {key}, path, grp order by i) as total
  from (select *, sum(long::int) over (partition by {key}, path order by i) as grp from p{k}) where not long)""")
        ctes.append(f"""r{k} as (
  select {key}, list_append(path, min(i)) as place, list(piece order by i) as ps, list(total order by i) as sums
  from s{k} group by {key}, path, grp)""")
        if k < last:
            ctes.append(f"""in{k + 1} as (
  select {key}, path, t from in{k} where not {has}
  union all select {key}, list_append(path, i), piece from p{k} where long)""")
    union = " union all ".join(f"select * from r{k}" for k in range(last + 1))
    return f"""with recursive {", ".join(ctes)},
runs as materialized ({union}),
steps as (
  select {key}, place, 1::bigint as a, len(list_filter(sums, lambda x: x <= {size})) as b from runs
  union all
  select {key}, place, a, len(list_filter(sums, lambda x: x - sums[a - 1] <= {size})) as b
  from (select {key}, place, sums, 2 + len(list_filter(sums[1:b], lambda x:
               sums[b] - x > {overlap} or sums[b + 1] - x > {size})) as a
        from steps join runs using ({key}, place) where b < len(sums))),
chunks as (
  select {key}, place, a, regexp_replace(array_to_string(ps[a:b], ''), '^\\s+|\\s+$', '', 'g') as chunk_text
  from steps join runs using ({key}, place))
select {key}, cast(row_number() over (partition by {key} order by place, a) - 1 + {start} as integer) as chunk_number, chunk_text
from chunks where chunk_text <> ''"""

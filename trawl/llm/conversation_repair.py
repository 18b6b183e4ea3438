"""Repair of the turn structure of conversations by a grammar-compressed dynamic program.

A repaired conversation has the roles ``s?(ua)+`` (system, user, assistant), or is empty.  Edits cost: Keep 0, Rerole to
user or assistant 2, Delete 3 (the only choice for blank and duplicate rows), Insert an empty user or assistant turn 2;
a truncated row that stays adds 1.  The audit is the string of the initials of the cheapest edits in order, the
ASCII-least of the cheapest.

1. Rows are ordered by (conversation, turn, role, text digest) in one distributed sort and numbered.  A row becomes one
   of nine symbols: its role's initial (s, u, a, other), in capitals if the row is truncated, or ``x`` if it must go.
   Symbols of ``SEGMENT`` consecutive rows of a conversation are one string.
2. Re-Pair over the distinct strings of all conversations: each round counts adjacent pairs in Spark, and gives the most
   frequent pairs that cannot overlap each other a new symbol; strings are rewritten in Spark.
3. Every rule has one min-plus transfer matrix between the four states of the role pattern (nothing yet, after system,
   after user, after assistant).  An entry holds the least cost and the audit as a rope, whose parts are the ropes of the
   two symbols of the rule.  Matrices are evaluated bottom-up, once for all conversations; a string's matrix is the
   product over its remaining symbols.
   Taking the least rope entry by entry is exact: audits of equal cost between the same two states over the same rows
   hold the same number of row letters and end in one, so none is the beginning of another.
4. Conversations of many segments are combined in groups of ``GROUP``, level by level, comparing audits by their rank in
   each segment; the chosen states go down the same levels.  No task sees more than one group.
5. The audits are spelled out as repaired rows and join the texts.

Defined results: rows in any order; null turns come first and count in no gap; a null role or text is one space; rows
without a conversation id are one conversation; equal turns are ordered by role and text digest; empty and very long
texts are rows as any other; repeated rows are duplicates; conversations without rows and empty tables give no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import let, materialize
from trawl.operators.crawl_log import with_index

#: Rows in a segment, segments (or groups of them) in a group.
SEGMENT = 256
GROUP = 256
#: Re-Pair: rounds, new rules in a round, and occurrences a pair must have.
ROUNDS = 8
RULES = 64
OCCURRENCES = 4

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_BLANK = r"[^ \x09-\x0D]"
_ENDED = r"[.!?][ \x09-\x0D]*\z"
#: First symbol of a rule (private use of Unicode).
_RULE = 0xE000


# ---------------------------------------------------------------- ropes and matrices

class Rope:
    """A string made of two ropes; parts are shared, nothing is copied."""
    __slots__ = ("text", "left", "right")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.text)
            else:
                todo += [r.right, r.left]
        return "".join(out)


def joined(a: Rope, b: Rope) -> Rope:
    return Rope(left=a, right=b)


def less(a: Rope, b: Rope) -> bool:
    """a < b; parts that are the same object are skipped."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if p.left is not None:
            x += [p.right, p.left]
            y.append(q)
        elif q.left is not None:
            x.append(p)
            y += [q.right, q.left]
        else:
            n = min(len(p.text), len(q.text))
            if p.text[:n] != q.text[:n]:
                return p.text < q.text
            if len(p.text) > n:
                x.append(Rope(p.text[n:]))
            if len(q.text) > n:
                y.append(Rope(q.text[n:]))
    return not any(str(p) for p in x) and any(str(q) for q in y)


# A matrix is a list of STATES x STATES entries (cost, rope), None where there is no way.

def better(a, b):
    """The entry of less cost, then the ASCII-least."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def onward(row: list, m: list) -> list:
    """A row vector of entries times a matrix."""
    out = [None] * STATES
    for k, e in enumerate(row):
        if e is None:
            continue
        for j in range(STATES):
            f = m[k * STATES + j]
            if f is not None and (out[j] is None or e[0] + f[0] <= out[j][0]):
                out[j] = better(out[j], (e[0] + f[0], joined(e[1], f[1])))
    return out


def times(a: list, b: list) -> list:
    return [e for i in range(STATES) for e in onward(a[i * STATES:(i + 1) * STATES], b)]


def _inserts() -> list:
    """Any number of inserted turns (two bring every state to where it can get)."""
    m = [None] * (STATES * STATES)
    for i in range(STATES):
        m[i * STATES + i] = (0, Rope(""))
        nxt = ASSISTANT if i == USER else USER
        m[i * STATES + nxt] = (INSERT, Rope("I"))
        if i in (START, SYSTEM):
            m[i * STATES + ASSISTANT] = (2 * INSERT, Rope("II"))
    return m


INSERTS = _inserts()


def _symbol(c: str) -> list:
    """The matrix of one row: inserted turns, then an edit of the row."""
    m = [None] * (STATES * STATES)

    def way(i: int, j: int, cost: int, edit: str) -> None:
        m[i * STATES + j] = better(m[i * STATES + j], (cost, Rope(edit)))

    for i in range(STATES):
        way(i, i, DELETE, "D")
        if c == "x":
            continue
        late = TRUNCATED if c.isupper() else 0
        nxt = ASSISTANT if i == USER else USER
        way(i, nxt, REROLE + late, "R")
        if c.lower() == "ua"[nxt == ASSISTANT]:
            way(i, nxt, late, "K")
        if c.lower() == "s" and i == START:
            way(START, SYSTEM, late, "K")
    return times(INSERTS, m)


def matrices(rules: list[tuple[str, str]]) -> dict[str, list]:
    """Symbol to matrix, rules bottom-up."""
    out = {c: _symbol(c) for c in "suaoSUAOx"}
    for k, (a, b) in enumerate(rules):
        out[chr(_RULE + k)] = times(out[a], out[b])
    return out


def row_of(symbols: str, start: int, known: dict[str, list]) -> list:
    row = [(0, Rope("")) if j == start else None for j in range(STATES)]
    for c in symbols:
        row = onward(row, known[c])
    return row


def closed(row: list):
    """The best of a row after the last inserted turns, in an accepted state."""
    end = onward(row, INSERTS)
    first = row[START]     # nothing has been put out
    return better(first, end[ASSISTANT])


# ---------------------------------------------------------------- Re-Pair in Spark

def _chosen(pairs: list[str]) -> list[str]:
    """Pairs, most frequent first, that cannot overlap each other."""
    left, right, out = set(), set(), []
    for p in pairs:
        if p[0] not in right and p[1] not in left:
            out.append(p)
            left.add(p[0])
            right.add(p[1])
    return out


def re_pair(strings: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(seq, many) to (seq, many, symbols), and the rules; at most ``ROUNDS`` x ``RULES`` of them."""
    rules: list[tuple[str, str]] = []
    out = strings.withColumn("symbols", F.col("seq"))
    for _ in range(ROUNDS):
        chars = F.filter(F.split("symbols", ""), lambda c: c != "")
        pairs = out.select(F.explode(let(chars, lambda c: F.transform(
            c, lambda x, i: F.concat(x, F.coalesce(F.get(c, i + 1), F.lit("")))))).alias("pair"))
        counts = pairs.filter(F.length("pair") == 2).groupBy("pair").count().filter(F.col("count") >= OCCURRENCES)
        found = _chosen([r.pair for r in counts.orderBy(F.desc("count"), "pair").limit(RULES).collect()])
        if not found:
            break
        symbols = F.col("symbols")
        for p in found:
            symbols = F.replace(symbols, F.lit(p), F.lit(chr(_RULE + len(rules))))
            rules.append((p[0], p[1]))
        out = materialize(out.withColumn("symbols", symbols), "repair-symbols")
    return out, rules


def _evaluated(rules: list[tuple[str, str]]):
    """(seq, many, symbols) to the entries of the string's matrix; all rows of the matrix only where ``many``."""
    def run(batches):
        known = matrices(rules)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rows = [row_of(r.symbols, i, known) if i == START or r.many else [None] * STATES for i in range(STATES)]
                cells = [e for row in rows for e in row]
                audits = [None if e is None else str(e[1]) for e in cells]
                order = {a: k for k, a in enumerate(sorted({a for a in audits if a is not None}))}
                end = closed(rows[START])
                out.append((r.seq, [None if e is None else e[0] for e in cells], audits,
                            [None if a is None else order[a] for a in audits], end[0], str(end[1])))
            yield pd.DataFrame(out, columns=["seq", "costs", "audits", "ranks", "cost", "audit"])
    return run


_EVALUATED = "seq string, costs array<long>, audits array<string>, ranks array<int>, cost long, audit string"


# ---------------------------------------------------------------- many segments

def _combined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Up to ``GROUP`` neighbouring nodes of a conversation as one: costs, ranks and the states between the nodes."""
    pdf = pdf.sort_values("seg")
    nodes = [([None if c is None or c != c else int(c) for c in costs], list(ranks))
             for costs, ranks in zip(pdf["costs"], pdf["ranks"])]
    cells = []
    for i in range(STATES):
        row = [(0, [], [i]) if j == i else None for j in range(STATES)]   # cost, ranks, states
        for costs, ranks in nodes:
            new = [None] * STATES
            for k, e in enumerate(row):
                for j in range(STATES):
                    c = costs[k * STATES + j]
                    if e is None or c is None:
                        continue
                    way = (e[0] + c, [*e[1], int(ranks[k * STATES + j])], [*e[2], j])
                    if new[j] is None or way[:2] < new[j][:2]:
                        new[j] = way
            row = new
        cells += row
    order = {r: k for k, r in enumerate(sorted({tuple(e[1]) for e in cells if e is not None}))}
    return pd.DataFrame([{
        "conv": key[0], "seg": int(key[1]),
        "costs": [None if e is None else e[0] for e in cells], "ranks": [None if e is None else order[tuple(e[1])] for e in cells],
        "states": ["" if e is None else "".join(map(str, e[2])) for e in cells]}])


_NODES = "conv string, seg long, costs array<long>, ranks array<int>, states array<string>"


def _top(pdf_batches):
    """The cheapest way through a whole conversation: its last state, cost and last inserted turns."""
    for pdf in pdf_batches:
        out = []
        for r in pdf.itertuples(index=False):
            best = None
            for j, (end, more) in {START: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}.items():
                if r.costs[j] is not None and r.costs[j] == r.costs[j]:
                    way = (int(r.costs[j]) + more, int(r.ranks[j]), j, end)
                    best = way if best is None or way < best else best
            out.append((r.conv, 0, START, best[2], best[0], best[3]))
        yield pd.DataFrame(out, columns=["conv", "seg", "entry", "exit", "cost", "tail"])


def _through(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, seg, entry, audit) and (conv, cost) of conversations with many segments (conv, seg, costs, ranks, audits)."""
    levels, nodes = [], segments.select("conv", "seg", "costs", "ranks")
    while True:
        nodes = nodes.withColumn("up", F.floor(F.col("seg") / GROUP)).groupBy("conv", "up") \
            .applyInPandas(_combined, _NODES)
        nodes = materialize(nodes, "repair-nodes")
        levels.append(nodes)
        if nodes.filter("seg > 0").isEmpty():
            break
    top = materialize(nodes.select("conv", "costs", "ranks").mapInPandas(
        _top, "conv string, seg long, entry int, exit int, cost long, tail string"), "repair-top")
    way = top.select("conv", "seg", "entry", "exit")
    for nodes in reversed(levels):
        states = F.element_at("states", F.col("entry") * STATES + F.col("exit") + 1)
        at = nodes.join(way, ["conv", "seg"]).select("conv", "seg", states.alias("s"))
        way = at.select("conv", "seg", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("k")) \
            .select("conv", (F.col("seg") * GROUP + F.col("k") - 1).alias("seg"),
                    F.expr("cast(substring(s, k, 1) as int)").alias("entry"),
                    F.expr("cast(substring(s, k + 1, 1) as int)").alias("exit"))
        way = materialize(way, "repair-way")
    last = segments.groupBy("conv").agg(F.max("seg").alias("seg")).join(top.select("conv", "tail"), "conv")
    audit = F.element_at("audits", F.col("entry") * STATES + F.col("exit") + 1)
    out = segments.join(way, ["conv", "seg"]).join(last, ["conv", "seg"], "left") \
        .select("conv", "seg", "entry", F.concat(audit, F.coalesce("tail", F.lit(""))).alias("audit"))
    return out, top.select("conv", "cost")


# ---------------------------------------------------------------- rows

def conversation_rows(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, conv_id, turn, role, text) with nulls as the module states; ``conv`` is never null."""
    i = F.col(f"`{id_col}`")
    return conversations.select(F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")).alias("conv"), i.alias("conv_id"),
                                F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame, id_col: str = "conv_id", parts: int = 20) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) modulo ``parts``: 0 drops a row, 1 empties its text, 2 removes the ends of
    its sentences, 3 repeats it, 4 makes it the user's."""
    rows = conversation_rows(conversations, id_col)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("hit", F.crc32(key) % parts).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))
    return rows.select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Every row without its text: its position in the conversation, its fault and its symbol."""
    text = F.col("text")
    light = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
                        (~F.rlike(text, F.lit(_BLANK))).alias("blank"), (~F.rlike(text, F.lit(_ENDED))).alias("open"))
    light = materialize(with_index(light, ["conv", "turn", "role", "digest"]), "repair-ordered")
    start = light.groupBy("conv").agg(F.min("_idx").alias("start"))
    again = light.groupBy("conv", "role", "digest").agg(F.min("_idx").alias("earliest"), F.count("*").alias("n")) \
        .filter("n > 1").drop("n")
    rows = light.join(start, "conv").join(again, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_idx") > F.col("earliest"), "duplicate") \
        .when(F.col("open"), "truncated").otherwise("")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x") \
        .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return rows.select("conv", (F.col("_idx") - F.col("start")).alias("pos"), "turn", "role", "digest", fault.alias("fault"),
                       initial.alias("initial")).withColumn("symbol", symbol)


def _legal(s: Column) -> Column:
    """Neighbours su, ua and au in a string of initials."""
    return sum(((F.length(s) - F.length(F.replace(s, F.lit(p)))) / 2).cast("long") for p in ("su", "ua", "au"))


def _spelled(batches):
    """(conv, seg, entry, audit) to the turns that stay: order in the segment, row of the segment (null: inserted), role."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            state, row = r.entry, 0
            for k, edit in enumerate(r.audit):
                if edit in "IR":
                    state = ASSISTANT if state == USER else USER
                    out.append((r.conv, r.seg, k, None if edit == "I" else row, edit, "assistant" if state == ASSISTANT else "user"))
                elif edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[r.seq[row].lower()]
                    out.append((r.conv, r.seg, k, row, edit, None))
                row += edit != "I"
        yield pd.DataFrame({c: pd.array(v, dtype=t) for c, t, v in zip(
            ("conv", "seg", "k", "row", "edit", "given"), ("object", "int64", "int64", "Int64", "object", "object"),
            zip(*out) if out else [[]] * 6)})


class Repair:
    """The repair of a table of conversation rows (see :func:`conversation_rows` and :func:`damage`).

    ``report``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation.
    ``turns``: the repaired rows (conv, seg, k, edit, role, text), in the order of (seg, k).
    """

    def __init__(self, rows: DataFrame):
        placed = materialize(_placed(rows), "repair-placed")
        seg = F.floor(F.col("pos") / SEGMENT)
        item = F.array_sort(F.collect_list(F.struct("pos", "symbol", "initial")))
        segments = placed.groupBy("conv", seg.alias("seg")).agg(
            item.alias("items"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        segments = segments.select("conv", "seg", "blank", "duplicate", "truncated",
                                   F.array_join(F.col("items.symbol"), "").alias("seq"),
                                   F.array_join(F.col("items.initial"), "").alias("initials"))
        long = segments.filter("seg > 0").select("conv").distinct().withColumn("many", F.lit(True))
        segments = materialize(segments.join(long, "conv", "left").withColumn("many", F.coalesce("many", F.lit(False))),
                               "repair-segments")
        strings = materialize(segments.groupBy("seq").agg(F.max("many").alias("many")), "repair-strings")
        symbols, rules = re_pair(strings)
        solved = materialize(symbols.mapInPandas(_evaluated(rules), _EVALUATED), "repair-solved")
        short = segments.filter("not many").join(solved, "seq")
        edits = short.select("conv", "seg", F.lit(START).alias("entry"), "audit")
        costs = short.select("conv", "cost")
        if not segments.filter("many").isEmpty():
            through, cost = _through(materialize(segments.filter("many").join(solved.drop("cost", "audit"), "seq")
                                                 .select("conv", "seg", "costs", "ranks", "audits"), "repair-long"))
            edits, costs = edits.unionByName(through), costs.unionByName(cost)
        self.edits = materialize(edits, "repair-edits")
        self.report = self._report(placed, segments, costs)
        self.turns = self._turns(rows, placed, segments)

    def _report(self, placed: DataFrame, segments: DataFrame, costs: DataFrame) -> DataFrame:
        inside = F.length("initials") - 1 - _legal(F.col("initials"))
        counts = segments.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                                              F.sum(inside).alias("illegal"))
        # neighbours over the end of a segment
        ends = segments.filter("many").select("conv", "seg", F.right("initials", F.lit(1)).alias("l"))
        heads = segments.filter("many").select("conv", (F.col("seg") - 1).alias("seg"), F.left("initials", F.lit(1)).alias("r"))
        across = ends.join(heads, ["conv", "seg"]).groupBy("conv").agg(
            F.count_if(~F.concat("l", "r").isin("su", "ua", "au")).alias("across"))
        turns = placed.select("conv", "turn").distinct().groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        audits = self.edits.groupBy("conv").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("seg", "audit")))["audit"], "").alias("audit"))
        return counts.join(turns, "conv").join(costs, "conv").join(audits, "conv").join(across, "conv", "left").select(
            "conv", "gaps", "blank", "duplicate", "truncated",
            (F.col("illegal") + F.coalesce("across", F.lit(0))).alias("illegal"), "cost", "audit")

    def _turns(self, rows: DataFrame, placed: DataFrame, segments: DataFrame) -> DataFrame:
        spelled = self.edits.join(segments.select("conv", "seg", "seq"), ["conv", "seg"]) \
            .mapInPandas(_spelled, "conv string, seg long, k long, row long, edit string, given string")
        spelled = spelled.withColumn("pos", F.col("seg") * SEGMENT + F.col("row"))
        kept = spelled.join(placed.select("conv", "pos", "turn", "role", "digest"), ["conv", "pos"], "left")
        # of equal rows only the first can stay, so (conv, role, digest) is unique among those that stay
        texts = rows.groupBy("conv", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min("text").alias("text"))
        return kept.join(texts, ["conv", "role", "digest"], "left").select(
            "conv", "seg", "k", "edit", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(conversations: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns (conv_id, position, edit, role, text) of a table of conversations."""
    rows = conversation_rows(conversations, id_col)
    done = Repair(rows)
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias(id_col))
    report = ids.join(done.report, "conv").drop("conv")
    longest = 3 * SEGMENT + 2     # letters of a segment's audit: two inserted turns before each row and at the end
    turns = done.turns.join(ids, "conv").select(id_col, (F.col("seg") * longest + F.col("k")).alias("position"),
                                                "edit", "role", "text")
    return report, turns


def _hashed(batches):
    """SHA-256 of the turns of each conversation, in order; a conversation may go on in the next batch."""
    now, sha = None, None
    for pdf in batches:
        out = []
        for conv, rows in groupby(zip(pdf["conv"], pdf["role"], pdf["text"]), key=lambda r: r[0]):
            if conv != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha, between = conv, hashlib.sha256(), b""
            for _, role, text in rows:
                sha.update(between + f"{role}:{text}".encode())
                between = b"\n"
        if out:
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if sha is not None:
        yield pd.DataFrame([(now, sha.hexdigest())], columns=["conv", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the hash is a sequence by definition, so the rows of a conversation stream through one
    task; nothing of it is held."""
    return turns.select("conv", "seg", "k", "role", "text").repartition("conv").sortWithinPartitions("conv", "seg", "k") \
        .select("conv", "role", "text").mapInPandas(_hashed, "conv string, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The report of the repair of ``rows`` for every conversation of ``conversations``, with the digest of its turns."""
    done = Repair(rows)
    ids = conversation_rows(conversations, id_col).groupBy("conv").agg(F.first("conv_id").alias(id_col))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(done.report, "conv", "left").join(digests(done.turns), "conv", "left").select(
        id_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

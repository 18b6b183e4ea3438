import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trawl.llm import conversation_repair as C
from trawl.llm.queries import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, conv string, seg string, fault string"
WS = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        t = text.strip(WS)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, turns) by a plain table over rows and states, whole audits and turns in every cell."""
    def after(state, c):      # states: "", s, u, a
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}
        return c if c in ok[state] else None

    def put(table, state, entry):
        if state is not None and (state not in table or entry < table[state]):
            table[state] = entry

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    put(table, after(state, c), (cost + 2, audit + "I", (*turns, (role, ""))))
        return table

    table = inserts({"": (0, "", ())})
    for (_, _, role, text), fault in zip(rows, found):
        new = {}
        for state, (cost, audit, turns) in table.items():
            put(new, state, (cost + 3, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            for c, name in (("u", "user"), ("a", "assistant")):
                put(new, after(state, c), (cost + 2 + late, audit + "R", (*turns, (name, text))))
            put(new, after(state, role[:1] or "?"), (cost + late, audit + "K", (*turns, (role, text))))
        table = inserts(new)
    return min(table[s] for s in ("", "a") if s in table)


def exhaustive(symbols):
    """The least (cost, audit) over all edits with at most two inserted turns in a gap."""
    best = None
    for edits in itertools.product(*[["D"] if c == "x" else ["D", "K", "u", "a"] for c in symbols]):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(symbols) + 1):
            roles, audit, cost = "", "", 0
            for k, gap in enumerate(gaps):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                if k < len(symbols):
                    e, c = edits[k], symbols[k]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and c.isupper())
                    roles += "" if e == "D" else c.lower() if e == "K" else e
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = order(damaged([r for r in rows if r[0] == conv]))
        found = faults(own)
        cost, audit, turns = cheapest(own, found)
        t = {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{role}:{x}" for role, x in turns)
        out[conv] = (max(t) - min(t) + 1 - len(t) if t else 0, found.count("blank"), found.count("duplicate"),
                     found.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def reported(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def made_up(seed, conversations, turns):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "user"]
    texts = ["Yes.", "No!", "Why", "Why?", "", None, " \n", "An end. ", "é", "open"]
    return [(c, t if rnd.random() < 0.97 else None, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"Text {t % 50}.")
            for c in range(conversations) for t in range(rnd.randint(1, turns)) if rnd.random() < 0.95]


def test_ropes_compare_like_strings():
    rnd = random.Random(2)
    for _ in range(2_000):
        a, b = ("".join(rnd.choice("DIK") for _ in range(rnd.randint(0, 5))) for _ in range(2))

        def rope(s):
            k = rnd.randint(0, len(s))
            return C.Rope(s) if len(s) < 2 or rnd.random() < 0.3 else C.joined(rope(s[:k]) if k < len(s) else C.Rope(s), rope(s[k:]) if k else C.Rope(""))

        x, y = rope(a), rope(b)
        assert C.less(x, y) == (str(x) < str(y))


def test_matrices_find_the_least_of_all_edits():
    known = C.matrices([])
    for symbols in [""] + ["".join(s) for n in (1, 2) for s in itertools.product("suaoSUAOx", repeat=n)] + ["uax", "ssu", "aUa", "oxS", "uuu", "aaa"]:
        cost, rope = C.closed(C.row_of(symbols, C.START, known))
        assert (cost, str(rope)) == exhaustive(symbols), symbols


def test_rules_equal_the_product_of_their_rows():
    rnd = random.Random(3)
    rules = [("u", "a"), (chr(0xE000), "x"), (chr(0xE001), chr(0xE000)), ("S", chr(0xE002)), (chr(0xE002), chr(0xE002))]
    plain = C.matrices([])

    def spelled(c):
        return c if ord(c) < 0xE000 else "".join(spelled(d) for d in rules[ord(c) - 0xE000])

    known = C.matrices(rules)
    for _ in range(50):
        s = "".join(rnd.choice(list(known)) for _ in range(rnd.randint(0, 8)))
        for start in range(C.STATES):
            got = [e and (e[0], str(e[1])) for e in C.row_of(s, start, known)]
            assert got == [e and (e[0], str(e[1])) for e in C.row_of("".join(map(spelled, s)), start, plain)]


@pytest.mark.parametrize("segment, group", [(256, 256), (4, 2)])
def test_equals_brute_force(spark, monkeypatch, segment, group):
    """Also with conversations over many segments and levels of groups."""
    monkeypatch.setattr(C, "SEGMENT", segment)
    monkeypatch.setattr(C, "GROUP", group)
    rows = made_up(5, 60, 9) + [(100 + c, *r[1:]) for c in range(2) for r in made_up(7 + c, 1, 90)]
    df = frame(spark, rows).repartition(5)
    got = reported(C.repair_report(df, C.damage(df)))
    assert got == brute(rows)


def test_grammar_is_shared_and_exact(spark):
    strings = spark.createDataFrame([("uaua" * k + "x" * (k % 3), k % 2 == 0) for k in range(1, 30)], "seq string, many boolean")
    symbols, rules = C.re_pair(strings)
    assert 0 < len(rules) <= C.ROUNDS * C.RULES

    def spelled(c):
        return c if ord(c) < 0xE000 else "".join(spelled(d) for d in rules[ord(c) - 0xE000])

    rows = symbols.collect()
    assert len(rows) == 29 and all("".join(map(spelled, r.symbols)) == r.seq for r in rows)
    assert sum(len(r.symbols) for r in rows) < 0.2 * sum(len(r.seq) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "A."), (1, 3, "user", "A."), (2, 5, "user", "x" * 100_000 + "."), (2, 9, "", "B?"),
            (None, 1, "assistant", "C."), (3, None, "system", "S."), (4, 0, "user", "é  "), (4, 0, "user", "é  "),
            *[(5, t, "user", "same.") for t in range(30)], *[(6, t, "usa"[t % 3], "z.") for t in range(9)]]
    df = frame(spark, rows)
    assert reported(C.repair_report(df, C.damage(df))) == brute(rows)
    none = frame(spark, rows).limit(0)
    assert C.repair_report(none, C.damage(none)).count() == 0
    gone = [(c, 0, "user", "x.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = frame(spark, gone)
    assert set(reported(C.repair_report(df, C.damage(df))).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "open"), (1, 3, "assistant", "A."), (2, 0, "assistant", "A.")]
    report, turns = C.repair(frame(spark, rows))
    got = {c: [(r.edit, r.role, r.text) for r in turns.filter(F.col("conv_id") == c).orderBy("position").collect()] for c in (1, 2)}
    assert got[2] == [("I", "user", ""), ("K", "assistant", "A.")]
    own = rows[:4]
    cost, audit, want = cheapest(own, faults(own))
    assert [(r, t) for _, r, t in got[1]] == list(want) and "".join(e for e, _, _ in got[1]) == audit.replace("D", "")
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (cost, audit), 2: (2, "IK")}


def test_query_equals_brute_force(spark, sf):
    for d in (sf, "/root/testdata/sf0.1"):
        table = spark.read.parquet(f"{d}/conversations.parquet")
        rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
        df = QUERIES["op11_grammar_repair"](spark, d)
        assert df.columns == COLUMNS and [t for c, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
        assert reported(df) == brute(rows)

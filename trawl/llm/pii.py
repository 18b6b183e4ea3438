"""Surrogates for personal data: keyed, of the same type and form, distinct, and the same for every mention.

Detection finds *units* ``(kind, value)``: e-mail addresses, telephone numbers, card and account numbers, social
security numbers, IBANs, IP addresses, and the given names and surnames of persons (after a form of address, or a
known given name before a capitalised surname; later bare mentions of such a surname in the same text count too).
``value`` is the canonical form (digits only, lower case), so differently written mentions are one unit.

A surrogate is a pure function of (key, kind, value, attempt): digits stay digits, letters stay letters of the same
script and case, separators, country code, card issuer digit and checksum validity stay, given names keep the
gender (one per name in the whole corpus: a known one wins, contradictory ones count as none).  The corpus decides the attempt: all units are brought together once as distinct rows, a surrogate that
equals an original unit or another unit's surrogate is rejected and its unit tries the next attempt, until none is
left.  From attempt ``WIDER`` on the space grows: numbers and addresses get longer, IP addresses move to another private
range and at last to IPv6, so units are placed however full a space of values is.  Nearly every unit keeps attempt 0, so documents are rewritten in place; only the exceptions are joined back,
by digest of the text.

Defined results: null text stays null, empty text stays empty, equal texts get equal results (repeated rows stay
repeated), a text without units is returned unchanged, other columns pass through.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import fresh, materialize, text_or_empty

#: Stands in where the caller gives no key; pass your own secret key in production.
DEMO_KEY = b"replace this key"

#: Attempts from which surrogates leave the form of their unit, and IP addresses that of IPv4.
WIDER, WIDEST = 8, 16
#: Digits that a number with a plus sign has at least.
MIN_PHONE = 7

# --- fixed values: forms of address, and names by script and gender ------------------------------------------------
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "Sir", "господин", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Lady",
          "госпожа", "κυρία"],
    "n": ["Dr", "Prof", "Doctor", "Professor"],
}
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Emma", "Laura", "Julia", "Sophie", "Claire", "Elena", "Lucia", "Carmen",
                     "Mary", "Sarah", "Alice", "Jane", "Emily", "Susan", "Petra", "Monika", "Camille", "Isabel"],
    ("latin", "m"): ["John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Daniel", "Martin",
                     "Pierre", "Jean", "Louis", "Hans", "Karl", "Stefan", "Carlos", "Miguel", "Pablo", "William"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Ειρήνη"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Γιάννης", "Κώστας", "Δημήτρης", "Πέτρος"],
}
SURNAMES = {
    "latin": ["Smith", "Miller", "Taylor", "Brown", "Walker", "Wright", "Baker", "Carter", "Fischer", "Weber",
              "Schneider", "Becker", "Martin", "Bernard", "Dubois", "Moreau", "Garcia", "Lopez", "Torres", "Romero"],
    "cyrillic": ["Иванов", "Петров", "Соколов", "Попов", "Лебедев", "Новиков", "Морозов", "Волков"],
    "greek": ["Παππάς", "Νικολάου", "Γεωργίου", "Ιωάννου", "Δημητρίου", "Βασιλείου"],
}

_UP, _LOW = "A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ", "a-zß-öø-ÿα-ωάέήίόύώςа-яё"
_NAME = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Each pattern is tried only where a cheap trigger (an @ sign, a digit, two capitalised words) stands.
_LOCAL = re.compile(r"[\w.%+-]+\Z")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile(
    rf"(?<![\w.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"
    r"|(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")
_CAPITALS = re.compile(rf"[{_UP}][{_LOW}]*\.? (?=[{_UP}])")
_TITLED = re.compile(rf"(?<!\w)(?P<title>{_TITLE})\.? (?P<names>{_NAME}(?: {_NAME}){{0,2}})(?!\w)")
_PAIR = re.compile(rf"(?<!\w)(?P<given>{'|'.join(n for ns in GIVEN.values() for n in ns)})"
                   rf" (?P<surname>{_NAME})(?!\w)")
_LOWER_TITLES = [t for ts in TITLES.values() for t in ts if t[0].islower()]
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_GENDER = {n: g for (_, g), ns in GIVEN.items() for n in ns}
_FIRST = {*_GENDER, *_GIVEN_GENDER}


def script_of(name: str) -> str:
    c = name[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


Span = tuple[int, int, str, str]


def canonical(kind: str, raw: str) -> str:
    """The value that all spellings of one entity share."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if raw.startswith("+") else "") + re.sub(r"\D", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    return raw.lower()


def _addresses(text: str) -> list[Span]:
    """E-mail addresses, searched around every @ sign."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        head = _LOCAL.search(text[max(out[-1][1] if out else 0, at - 256):at])
        tail = _DOMAIN.match(text, at + 1)
        if head and tail:
            out.append((at - len(head.group()), tail.end(), "email", text[at - len(head.group()):tail.end()].lower()))
        at = text.find("@", at + 1)
    return out


def _numbers(text: str, taken: list[tuple[int, int]]) -> list[Span]:
    """Numbers of all kinds, tried at every run of digits that no address holds."""
    out: list[Span] = []
    end, k = 0, 0
    for run in _DIGITS.finditer(text):
        at = run.start()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        if at < end or k < len(taken) and taken[k][0] <= at:
            continue
        for start in (at - 2, at - 1, at):
            if start >= end and (m := _NUMBER.match(text, start)) and m.end() > at:
                value = canonical(m.lastgroup, m.group())
                if m.lastgroup == "phone" and len(value.lstrip("+")) < MIN_PHONE:
                    continue
                out.append((start, m.end(), m.lastgroup, value))
                end = m.end()
                break
    return out


def detect(text: str | None) -> list[Span]:
    """(start, end, kind, value) of every unit, in order, without overlaps."""
    if not text:
        return []
    spans = _addresses(text) if "@" in text else []
    spans += _numbers(text, [(a, b) for a, b, _, _ in spans])
    taken = [(a, b) for a, b, _, _ in spans]
    people: list[Span] = []
    surnames: set[str] = set()

    def person(start: int, names: list[str], gender: str) -> None:
        at = start
        for k, name in enumerate(names):
            last = k == len(names) - 1
            kind = "surname" if last else f"given_{_GIVEN_GENDER.get(name, gender)}"
            people.append((at, at + len(name), kind, name.lower()))
            if last and len(name) >= 3:
                surnames.add(name)
            at += len(name) + 1

    starts = [m.start() for m in _CAPITALS.finditer(text) if m.group().rstrip(". ") in _FIRST]
    for title in _LOWER_TITLES:
        if title in text:
            starts += [m.start() for m in re.finditer(title, text)]
    for start in starts:
        if m := _TITLED.match(text, start):
            person(m.start("names"), m["names"].split(" "), _GENDER[m["title"]])
    for start in starts:
        if (m := _PAIR.match(text, start)) and not any(a <= start < b for a, b, _, _ in people):
            person(start, [m["given"], m["surname"]], _GIVEN_GENDER[m["given"]])
    if surnames:
        known = {a for a, _, _, _ in people}
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(surnames, key=len, reverse=True)))})(?!\w)")
        people += [(m.start(), m.end(), "surname", m.group().lower()) for m in again.finditer(text)
                   if m.start() not in known]
    spans += [p for p in people if not any(a < p[1] and p[0] < b for a, b in taken)]
    out: list[Span] = []
    for s in sorted(set(spans)):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


# --- surrogates ------------------------------------------------------------------------------------------------------

def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    """An endless keyed stream of numbers below 2**16."""
    block = 0
    while True:
        d = hmac.new(key, f"{kind}\0{value}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(d[i:i + 2], "big") for i in range(0, 32, 2))
        block += 1


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _letters(value: str, s: Iterator[int]) -> str:
    """Letters become letters of the same case, digits digits; the rest stays."""
    def one(c: str) -> str:
        if c.isdigit():
            return str(next(s) % 10)
        if c.isalpha():
            out = chr(97 + next(s) % 26)
            return out.upper() if c.isupper() else out
        return c
    return "".join(map(one, value))


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a unit."""
    s = _stream(key, kind, value, attempt)
    longer = max(0, attempt - WIDER + 1)  # characters beyond the form
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels, top = domain.rsplit(".", 1)
        # the domain has its own stream: addresses of one domain stay together
        return f"{_letters(local + 'a' * longer, s)}@{_letters(labels, _stream(key, 'domain', domain, 0))}.{top}"
    if kind == "ip":
        a = [int(x) for x in value.split(".")]
        kept = 2 if a[:2] == [192, 168] else 1 if a[0] in (0, 10, 127) or a[0] >= 224 else 0
        if attempt >= WIDEST:  # a private address stays private, others come from the range for documentation
            head = [0xfd00 + next(s) % 256, next(s)] if kept else [0x2001, 0x0db8]
            return ":".join(f"{x:x}" for x in [*head, *(next(s) for _ in range(6))])
        if attempt >= WIDER and kept == 2:
            a, kept = [10], 1
        new = a[:kept] + [next(s) % 254 + 1 for _ in range(4 - kept)]
        if not kept:  # a public address stays public
            new[0] = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192, 198, 203)][new[0] % 216]
        return ".".join(map(str, new))
    if kind in ("phone", "ssn", "card"):
        plus = value.startswith("+")
        d = value[1:] if plus else value
        head = d[:1] if kind == "card" else d[:max(1, len(d) - 10)] if plus else ""
        body = [next(s) % 10 for _ in range(len(d) - len(head) + longer)]
        if body and kind != "card" and d[len(head)] not in "01":
            body[0] = 2 + body[0] % 8
        new = head + "".join(map(str, body))
        if kind == "card":
            check = (10 - _luhn(new[:-1] + "0")) % 10
            new = new[:-1] + str(check if _luhn(d) == 0 else (check + 1 + next(s) % 9) % 10)
        return ("+" if plus else "") + new
    if kind == "iban":
        body = "".join(str(next(s) % 10) if c.isdigit() else chr(65 + next(s) % 26) for c in value[4:] + "0" * longer)
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - rest % 97:02d}{body}"
    # names: one name of the pool, one more joined to it with each further attempt
    script = script_of(value)
    if kind == "surname":
        pool = SURNAMES[script]
    else:
        gender = kind[-1]
        pool = GIVEN[script, gender] if gender in "fm" else GIVEN[script, "f"] + GIVEN[script, "m"]
    return "-".join(pool[next(s) % len(pool)] for _ in range(attempt + 1)).lower()


def dress(kind: str, raw: str, new: str) -> str:
    """Write a canonical surrogate the way the mention was written: same separators, same case."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in raw) + "".join(chars)
    if kind == "email":
        return new.upper() if raw.isupper() else "".join(
            c.upper() if o.isupper() else c for c, o in zip(new, raw)) if len(new) == len(raw) else new
    if kind == "ip":
        return new
    return new.upper() if raw.isupper() and len(raw) > 1 else new.title()


def rewrite(text: str | None, key: bytes,
            attempts: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, int]:
    """The text with every unit replaced, and the number of mentions; ``attempts`` are the (kind, attempt) of units
    that keep not their own kind or not attempt 0."""
    spans = detect(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in spans:
        as_kind, attempt = attempts.get((kind, value), (kind, 0))
        out += [text[at:a], dress(kind, text[a:b], surrogate(key, as_kind, value, attempt))]
        at = b
    return "".join(out) + text[at:], len(spans)


# --- the corpus ------------------------------------------------------------------------------------------------------

def find_units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, kind, value): the distinct units of every text, the text named by its digest."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(d, k, v) for d, t in zip(pdf["digest"], pdf["text"])
                    for k, v in dict.fromkeys((k, v) for _, _, k, v in detect(t))]
            yield pd.DataFrame(rows, columns=["digest", "kind", "value"])

    text = text_or_empty(f"`{text_col}`")
    return docs.select(F.md5(text).alias("digest"), text.alias("text")) \
        .mapInPandas(batches, "digest string, kind string, value string").distinct()


def resolve_given(units: DataFrame) -> DataFrame:
    """(kind, value, as_kind) of distinct units: every given name gets one kind, whatever its mentions say."""
    is_given = F.col("kind").startswith("given_")
    f, m = (F.array_contains("kinds", f"given_{g}") for g in "fm")
    # three kinds at most
    names = units.filter(is_given).groupBy("value").agg(F.collect_set("kind").alias("kinds")) \
        .select(F.explode("kinds").alias("kind"), "value",
                F.when(f & ~m, "given_f").when(m & ~f, "given_m").otherwise("given_n").alias("as_kind"))
    return units.filter(~is_given).select("kind", "value", F.col("kind").alias("as_kind")).unionByName(names)


def assign_attempts(units: DataFrame, key: bytes, max_rounds: int = 64) -> DataFrame:
    """(kind, value, attempt) of the units whose first surrogate is not free; all others keep attempt 0.

    A surrogate is free if it equals no original unit of its kind and no surrogate given before (given names count
    as one kind); of several units that want the same one, the smallest gets it.
    """
    space = F.when(F.col("kind").startswith("given_"), "given").otherwise(F.col("kind")).alias("space")

    def proposed(pending: DataFrame, attempt: int) -> DataFrame:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pdf.assign(sur=[surrogate(key, k, v, attempt) for k, v in zip(pdf["kind"], pdf["value"])])
        return pending.mapInPandas(batches, "kind string, value string, sur string")

    taken = units.select(space, F.col("value").alias("sur"))
    pending, late = units, []
    for attempt in range(max_rounds):
        want = materialize(proposed(pending, attempt).select("*", space), "surrogates")
        won = materialize(want.join(taken, ["space", "sur"], "left_anti").groupBy("space", "sur")
                          .agg(F.min(F.struct("value", "kind")).alias("unit")).select("space", "sur", "unit.*"),
                          "surrogates-won")
        if attempt:
            late.append(won.select("kind", "value", F.lit(attempt).alias("attempt")))
        lost = materialize(want.select("kind", "value").join(won, ["kind", "value"], "left_anti"), "surrogates-lost")
        if lost.isEmpty():
            break
        pending, taken = lost, taken.unionByName(won.select("space", "sur"))
    else:
        raise RuntimeError("no free surrogates left")
    none = units.select("kind", "value", F.lit(0).alias("attempt")).limit(0)
    for part in late:
        none = none.unionByName(part)
    return none


def pseudonymize(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text",
                 count_col: str | None = None) -> DataFrame:
    """``docs`` with every unit replaced in ``text_col`` (and the number of mentions in ``count_col``)."""
    found = materialize(find_units(docs, text_col), "pii-units")
    units = materialize(resolve_given(found.select("kind", "value").distinct()), "pii-distinct")
    late = materialize(assign_attempts(units.select(F.col("as_kind").alias("kind"), "value").distinct(), key), "pii-late")
    late = late.withColumnRenamed("kind", "as_kind")
    odd = units.join(late, ["as_kind", "value"]).unionByName(
        units.filter("kind <> as_kind").join(late, ["as_kind", "value"], "left_anti").withColumn("attempt", F.lit(0)))
    # a document's own exceptions only: bounded by the text they come from
    digest, given, out = (fresh(docs.columns, x) for x in ("digest__", "late__", "rewritten__"))
    amend = materialize(found.join(odd, ["kind", "value"]).groupBy(F.col("digest").alias(digest))
                        .agg(F.collect_list(F.struct("kind", "value", "as_kind", "attempt")).alias(given)), "pii-amend")

    @F.pandas_udf("text string, n long")
    def rewritten(text: pd.Series, late_units: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(text, late_units):
            own = {} if own is None else {(u["kind"], u["value"]): (u["as_kind"], u["attempt"]) for u in own}
            rows.append(rewrite(t, key, own))
        return pd.DataFrame(rows, columns=["text", "n"])

    df = docs.withColumn(digest, F.md5(text_or_empty(f"`{text_col}`"))).join(amend, digest, "left")
    df = df.withColumn(out, rewritten(F.col(f"`{text_col}`"), F.col(given)))
    cols = [F.col(f"{out}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*cols, *([F.col(f"{out}.n").alias(count_col)] if count_col else []))

"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

1. Spark counts the words of all documents (each task keeps a bounded summary, the summaries are summed), and the
   most frequent ``LEXICON_WORDS`` are encoded once.
2. They are compiled into a minimal acyclic automaton whose states share suffixes.  Every transition carries the
   number of words that sort before it, so the sum along a path is the word's place in sorted order: a perfect hash
   into the array of its ids.  The automaton is a few flat arrays in one file that Spark distributes; the Python
   workers of a node map the same file into memory.
3. A document is normalised and cut into words as the vocabulary file says, known words get their ids from the
   automaton (a whole set of words walks it at once), and unseen words are merged exactly, pair by pair.  The
   lexicon decides speed alone, never a result.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; the strings
of the special tokens become their ids, as the vocabulary file marks them; repeated rows are encoded one by one;
long texts are read piecewise.  Letters are those of
the installed character tables: characters newer than Unicode 15 can be cut otherwise than the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import materialize, text_or_empty

#: Most words in the lexicon, and most that one task's summary keeps.
LEXICON_WORDS = 100_000
SUMMARY_WORDS = 200_000
#: Words that a worker remembers, besides the lexicon.
CACHE_WORDS = 300_000
#: Words that are looked up together, and code points of short texts that are taken together.
PIECE = 1 << 16
GROUP_CHARS = 1 << 19
END = "</w>"

# Letters, digits and spaces below U+0250, and the vocabulary file's word pattern over them.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\x09-\x0d\x20\x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next free letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, ranked merges and special tokens of a vocabulary file, and the exact merging of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        #: rank of a pair of ids (packed into one number), and what the merge of that rank gives
        self.rank = {ids[a] << 20 | ids[b]: r for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.made = [ids[a + b] for a, b in spec["model"]["merges"]]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + END] for c in letters]
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text, and the ids of special tokens, in order."""
        at = 0
        for m in self._special.finditer(text) if "<" in text else ():
            yield text[at:m.start()], None
            yield "", self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def merge(self, word: str) -> list[int]:
        """The ids of one word: always the merge of lowest rank first, leftmost among equals."""
        raw = word.encode("utf-8", "surrogatepass")
        seq = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(seq) > 64:
            return self._merge_long(seq)
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(a << 20 | b, none) for a, b in zip(seq, seq[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            seq[k] = self.made[best]
            del seq[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(seq[k - 1] << 20 | seq[k], none)
            if k < len(ranks):
                ranks[k] = rank(seq[k] << 20 | seq[k + 1], none)
        return seq

    def _merge_long(self, seq: list[int]) -> list[int]:
        """The same through a heap of pairs over a linked list: n log n."""
        n = len(seq)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, pair) for k, pair in enumerate(a << 20 | b for a, b in zip(seq, seq[1:]))
                if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, pair = heapq.heappop(heap)
            j = nxt[k]
            if not live[k] or j >= n or seq[k] << 20 | seq[j] != pair:
                continue
            seq[k], live[j], nxt[k] = self.made[r], False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = k
            for a in (prv[k], k):
                b = nxt[a] if a >= 0 else n
                if a >= 0 and b < n:
                    pair = seq[a] << 20 | seq[b]
                    if (r := self.rank.get(pair)) is not None:
                        heapq.heappush(heap, (r, a, pair))
        return [s for s, alive in zip(seq, live) if alive]


def words_of(text: str) -> Iterator[str]:
    """The words of ordinary text: composed, lower case, cut by the word pattern."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # each letter by itself: no final sigma
    text = text.lower()
    pattern = _ANY if not text.isascii() and _BEYOND.search(text) else _LATIN
    return (m.group() for m in pattern.finditer(text)) if len(text) > 1 << 20 else iter(pattern.findall(text))


# --- the lexicon: a minimal acyclic automaton -----------------------------------------------------------------------

class Lexicon:
    """Flat arrays of a minimal acyclic automaton over sorted words, with ids as outputs.

    ``keys`` holds ``state << 21 | code point`` of every transition in order, ``target`` where it leads and
    ``skipped`` how many words sort before those behind it; ``final`` marks accepting states; the ids of word number
    ``k`` are ``ids[start[k]:start[k + 1]]``.
    """

    NAMES = ("keys", "target", "skipped", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[str, list[int]]) -> Lexicon:
        """Words are added in order; a finished state equal to a known one is replaced by it at once."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []

        def frozen(final: bool, edges: list[tuple[int, int]]) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append((final, edges))
            return register[key]

        path: list[list] = [[False, []]]  # open states of the last word: [final, edges]
        last = ""
        for word in [*words, None]:
            common = 0 if word is None else len(os.path.commonprefix([last, word]))
            while len(path) - 1 > common:
                final, edges = path.pop()
                path[-1][1].append((ord(last[len(path) - 1]), frozen(final, edges)))
            if word is not None:
                path += [[False, []] for _ in word[common:]]
                path[-1][0] = True
                last = word
        root = frozen(*path[0])
        # number the states anew with the root first; count the words behind each
        order = [root, *(s for s in range(len(states)) if s != root)]
        place = {s: k for k, s in enumerate(order)}
        behind = [0] * len(states)
        for s, (final, edges) in enumerate(states):  # states are frozen after those they lead to
            behind[s] = final + sum(behind[t] for _, t in edges)
        keys, target, skipped = [], [], []
        for s in order:
            before = int(states[s][0])
            for c, t in states[s][1]:
                keys.append(place[s] << 21 | c)
                target.append(place[t])
                skipped.append(before)
                before += behind[t]
        start = np.cumsum([0, *(len(entries[w]) for w in words)])
        return cls({"keys": np.array(keys, np.int64), "target": np.array(target, np.int64),
                    "skipped": np.array(skipped, np.int64), "final": np.array([states[s][0] for s in order], bool),
                    "start": start.astype(np.int64),
                    "ids": np.array([i for w in words for i in entries[w]], np.int64)})

    def save(self, path: str) -> None:
        """All arrays in one file: a line of lengths, then the numbers."""
        arrays = [np.asarray(getattr(self, n), np.int64) for n in self.NAMES]
        with open(path, "wb") as f:
            f.write(np.array([len(a) for a in arrays], np.int64).tobytes())
            for a in arrays:
                f.write(a.tobytes())

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Map the file into memory."""
        data = np.memmap(path, np.int64, "r")
        ends = np.cumsum([len(cls.NAMES), *data[:len(cls.NAMES)]])
        return cls({n: data[a:b] for n, a, b in zip(cls.NAMES, ends, ends[1:])})

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word in sorted order, -1 where it is unknown; all words walk together."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return out
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.cumsum(length) - length
        live, state, rank = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(int(length.max())):
            done = length[live] == k
            hit = live[done][np.asarray(self.final)[state[live[done]]] != 0]
            out[hit] = rank[hit]
            live = live[~done]
            if not len(live):
                break
            key = state[live] << 21 | code[at[live] + k]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[e] == key
            live, e = live[ok], e[ok]
            state[live] = self.target[e]
            rank[live] += self.skipped[e]
        done = live[length[live] == length.max()] if len(live) else live
        hit = done[np.asarray(self.final)[state[done]] != 0]
        out[hit] = rank[hit]
        return out

    def outputs(self, place: int) -> np.ndarray:
        return self.ids[self.start[place]:self.start[place + 1]]


class Encoder:
    """Text to ids and back, with a lexicon for frequent words and exact merging for the rest."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {}

    def _learn(self, lists: Iterable[list[str]]) -> None:
        """Make the words of the lists known; what the lexicon does not hold is merged."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*lists).difference(self.known))
        places = self.lexicon.places(new).tolist() if self.lexicon is not None else [-1] * len(new)
        for w, p in zip(new, places):
            ids = self.lexicon.outputs(p) if p >= 0 else np.array(self.vocabulary.merge(w))
            self.known[w] = ids.astype("<u4").tobytes()

    def _of(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian 32-bit numbers, piece by piece."""
        for plain, special in self.vocabulary.segments(text):
            if special is not None:
                yield int(special).to_bytes(4, "little")
                continue
            it = words_of(plain)
            while words := list(islice(it, PIECE)):
                self._learn([words])
                yield self._of(words)

    def many(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """The pieces of each text; the words of neighbouring short texts are looked up together."""
        group: list[list[tuple[list[str], int | None]]] = []
        size = 0

        def flush() -> Iterator[Iterator[bytes]]:
            self._learn(words for segments in group for words, _ in segments)
            for segments in group:
                yield (self._of(w) if i is None else int(i).to_bytes(4, "little") for w, i in segments)
            group.clear()

        for text in texts:
            if len(text) > GROUP_CHARS or size + len(text) > GROUP_CHARS:
                yield from flush()
                size = 0
            if len(text) > GROUP_CHARS:
                yield self.pieces(text)
                continue
            group.append([(list(words_of(plain)), i) for plain, i in self.vocabulary.segments(text)])
            size += len(text)
        yield from flush()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.pieces(text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file has no decoder: tokens joined by blanks."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


# --- the corpus -------------------------------------------------------------------------------------------------------

def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents (at most ``most``), by summed bounded summaries of the tasks."""
    def summary(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for pdf in it:
            for text in pdf["text"]:
                words = words_of(text)
                while part := list(islice(words, PIECE)):
                    seen.update(part)
                if len(seen) > 2 * SUMMARY_WORDS:
                    seen = Counter(dict(seen.most_common(SUMMARY_WORDS)))
        top = [(w, n) for w, n in seen.most_common(most) if n > 1 and w.isprintable()]
        yield pd.DataFrame(top, columns=["word", "n"])

    counts = docs.select(text_or_empty(f"`{text_col}`").alias("text")).mapInPandas(summary, "word string, n long")
    summed = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # a histogram of the counts (eighths of powers of two, so a few hundred rows) tells where to cut
    level = F.floor(F.log2("n") * 8).cast("int")
    left, cut = most, None
    for r in sorted(summed.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if r["count"] > left:
            break
        left, cut = left - r["count"], r["level"]
    return [] if cut is None else [r["word"] for r in summed.filter(level >= cut).select("word").collect()]


def ship_lexicon(spark: SparkSession, lexicon: Lexicon) -> str:
    """Hand the lexicon's file to Spark, which brings it to every node; returns its name there."""
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lexicon-")), f"lexicon-{uuid.uuid4().hex}.bin")
    lexicon.save(path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def worker_encoder(vocabulary_path: str, lexicon_name: str) -> Encoder:
    """The encoder of this Python worker; its lexicon is mapped, not read."""
    key = (vocabulary_path, lexicon_name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(vocabulary_path), Lexicon.load(SparkFiles.get(lexicon_name)))
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; ``with_ids`` adds the ids themselves."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path)
    lexicon = Lexicon.build({w: vocabulary.merge(w) for w in frequent_words(docs, text_col)})
    name = ship_lexicon(spark, lexicon)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = worker_encoder(vocabulary_path, name)
        for pdf in it:
            rows = []
            for pieces in enc.many(pdf["text"]):
                n, h_ids, h_text, blank, kept = 0, hashlib.sha256(), hashlib.sha256(), "", []
                for piece in pieces:
                    ids = np.frombuffer(piece, "<u4")
                    if not len(ids):
                        continue
                    h_ids.update(piece)
                    h_text.update((blank + enc.decode(ids.tolist())).encode("utf-8", "surrogatepass"))
                    n, blank = n + len(ids), " "
                    if with_ids:
                        kept.append(ids)
                rows.append((n, h_ids.hexdigest(), h_text.hexdigest(), *(
                    (np.concatenate([np.empty(0, np.int32), *kept]).astype(np.int32),) if with_ids else ())))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256",
                                              *(["ids"] if with_ids else [])])
            yield out.assign(doc_id=pdf["doc_id"])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" \
        + (", ids array<int>" if with_ids else "") + ", doc_id long"
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      text_or_empty(f"`{text_col}`").alias("text"))
    return src.mapInPandas(batches, schema).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.odd import ROWS, no_docs, odd_docs
from trawl.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["", "  ", "<|startoftext|>Hello<|endoftext|> <|endoftext", "ΑΣ Σ όΣ", "İstanbul", "é 가", "\x1c\x1d a\x85b c​d",
       "日本語 ²½Ⅷ १२३", "a" * 500, "!?" * 300 + "\x00x", "it's we've 'S I'LL", "\U0001F600\U0001F1E9", "ſK ﬁ", "xyz " * 3]


def test_encoding_equals_the_library(vocabulary, library):
    for lexicon in (None, B.Lexicon.build({w: vocabulary.merge(w) for w in ("hello", "it", "日本語", "!?")})):
        enc = B.Encoder(vocabulary, lexicon)
        for text in ODD:
            want = library.encode(text, add_special_tokens=False).ids
            assert enc.encode(text) == want, ascii(text)
            assert enc.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words_and_many_merges(vocabulary, library):
    rnd = random.Random(1)
    for n in (63, 64, 65, 300, 5_000):
        word = "".join(rnd.choice("thandioer") for _ in range(n))
        assert vocabulary.merge(word) == library.encode(word, add_special_tokens=False).ids


def test_automaton_is_exact_minimal_and_mapped(tmp_path):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(3_000)} | {"日本", "a"}
    entries = {w: [rnd.randrange(1_000) for _ in range(rnd.randrange(1, 5))] for w in words}
    lex = B.Lexicon.build(entries)
    lex.save(str(tmp_path / "lex"))
    lex = B.Lexicon.load(str(tmp_path / "lex"))
    assert isinstance(lex.keys, np.memmap)
    known = sorted(words)
    assert lex.places(known).tolist() == list(range(len(known)))
    assert all(lex.outputs(k).tolist() == entries[w] for k, w in enumerate(known))
    others = ["", "x", "abababababab", "日", "日本語"] + [w + "c" for w in known[:50]]
    assert set(lex.places(others).tolist()) == {-1}
    suffixes = {tuple(sorted(w[i:] for w in words if w.startswith(p))) for p in {w[:k] for w in words for k in range(len(w) + 1)}
                for i in [len(p)]}
    assert len(lex.final) == len(suffixes)  # one state for each set of endings: minimal
    assert B.Lexicon.build({}).places(["a"]).tolist() == [-1]


def check(rows, texts, library):
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        if "ids" in r.asDict():
            assert r.ids == ids


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = B.encode_documents(docs, PATH, with_ids=True).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, library)


def test_odd_rows(spark, library, monkeypatch):
    rows = B.encode_documents(odd_docs(spark), PATH).collect()
    assert len(rows) == len(ROWS)
    check(rows, {r[0]: r[1] for r in ROWS}, library)
    assert B.encode_documents(no_docs(spark), PATH).count() == 0


def test_pieces_of_a_long_text(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "GROUP_CHARS", 200)
    monkeypatch.setattr(B, "PIECE", 7)
    monkeypatch.setattr(B, "CACHE_WORDS", 20)
    enc = B.Encoder(vocabulary, None)
    texts = [" ".join(f"w{k % 13} tail{j}" for k in range(60)) for j in range(5)] + ["short", "", "<|endoftext|>x"]
    got = [b"".join(p) for p in enc.many(texts)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]

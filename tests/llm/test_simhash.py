import random

import numpy as np
import pandas as pd
import xxhash

from tests.llm.odd import ROWS, no_docs, odd_docs
from trawl.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
             if w]
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def near_copies(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    while len(out) < n:
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((40, 200)))]
        for _ in range(rnd.choice((1, 1, 4, 9))):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 2))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
    return out[:n]


def test_fingerprints_equal_brute_force():
    for text in [r[1] for r in ROWS if r[1] is None or len(r[1]) < 10_000] + near_copies(1, 20):
        assert S.fingerprint(S.shingle_hashes(text)) & (1 << 64) - 1 == brute_fingerprint(text)


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 16)  # deep trees, and leaves dealt out in blocks
    texts = near_copies(2, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = S.near_duplicates(docs).toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == list(range(300))
    assert got.component_id.tolist() == brute_components([brute_fingerprint(t) for t in texts])
    kept = S.drop_near_duplicates(docs).toPandas()
    assert sorted(kept.doc_id) == sorted(set(got.component_id))


def test_tree_visits_every_neighbour():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
    x = np.concatenate([x, x[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))])
    for mask in (0xFFFFFFFF, 0xFFFFFFFF00000000):
        tree = S.fit_tree(x[:1_000], mask, 1, 7)
        home, (i, leaf) = tree.home(x), tree.visits(x)
        visited = set(zip(i.tolist(), leaf.tolist()))
        d = np.bitwise_count((x[:, None] ^ x[None, :]) & np.uint64(mask))
        assert len(np.unique(home)) > 10
        for a, b in zip(*np.nonzero(d <= 1)):
            assert (int(a), int(home[b])) in visited


def test_spanning_links_connect_like_all_pairs():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centre]))
    a, b = S.spanning_links(x, x, 3)
    assert len(a) < len(x)
    table = pd.Series(range(len(x)), index=x)
    label = np.arange(len(x))
    S._union(label, table[a].to_numpy(), table[b].to_numpy())
    assert label.tolist() == brute_components(x.tolist())


def test_odd_rows(spark):
    got = S.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ROWS)
    empty = {r.doc_id: r for r in got if r.fp == 0}
    assert set(empty) == {2, 3, 5} and {r.component_id for r in empty.values()} == {2}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = S.drop_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [
        (False, -7), (False, 1), (False, 2), (False, 4), (False, 6), (True, None)]
    assert S.near_duplicates(no_docs(spark)).count() == 0 and S.drop_near_duplicates(no_docs(spark)).count() == 0


def test_one_id_with_two_texts_keeps_both_groups(spark):
    a, b = near_copies(5, 2)[0], "entirely different words stand in this other text of the same id"
    docs = spark.createDataFrame([(1, a), (1, b), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in S.drop_near_duplicates(docs).collect()) == sorted([(1, a), (1, b)])

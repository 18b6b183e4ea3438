import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.conftest import SMALL
from tests.llm.odd import no_docs, odd_docs
from tests.llm.test_simhash import brute_components, brute_fingerprint
from trawl.llm import mixing, pii
from trawl.llm.mixing import with_probability
from trawl.llm.quality_rules import quality_rules
from trawl.session import materialize


def test_every_stage_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)  # fewer cycles
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(C.STAGES)
    good = materialize(stages["quality rules"](spark, docs, SMALL), "t")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    kept = materialize(stages["simhash near-duplicates"](spark, good, SMALL), "t")
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[k][0] for k in roots})
    clean = materialize(stages["pii surrogates"](spark, kept, SMALL), "t")
    before = {r.doc_id: r.text for r in kept.collect()}
    for r in clean.collect():
        old, new = pii.detect(before[r.doc_id]), pii.detect(r.text)
        assert [k for _, _, k, _ in old] == [k for _, _, k, _ in new] and r.n_chars == len(r.text)
        assert not {v for *_, v in old} & {v for *_, v in new} and (old or r.text == before[r.doc_id])
    drawn = materialize(stages["mixing"](spark, clean, SMALL), "t")
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in with_probability(clean).filter("sampled").collect()}
    assert all(x.columns == docs.columns for x in (good, kept, clean, drawn)) and 0 < drawn.count() < clean.count()
    texts = {r.doc_id: r.text for r in drawn.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = stages["bpe"](spark, drawn, SMALL).collect()
    assert {r.doc_id for r in out} == texts.keys()
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out)
    whole = C.run(spark, SMALL)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_odd_rows_and_empty_tables(spark):
    for docs in (odd_docs(spark), no_docs(spark), odd_docs(spark).withColumn("text", F.lit(None).cast("string"))):
        for name, stage in C.STAGES:
            out = materialize(stage(spark, docs, SMALL), "t")
            assert name == "bpe" or out.columns == docs.columns
            docs = out
        assert np.isfinite(docs.count())

"""Registered chunking, embedding, retrieval-with-text and prompt queries.

Chunks are the overlapping windows (T8) of the whole ``documents`` table;
questions are every user turn of ``conversations``; the embedder is the
built-in token-hash model (dim 64) on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions.vectors import as_vector
from trawl.operators import chunk_versions as CV
from trawl.operators import chunks as CH
from trawl.operators import embed as E
from trawl.operators import rag as RG
from trawl.operators import retrieve as RT
from trawl.operators import vector_index as VI
from trawl.operators.crawl_log import orphan_chunks
from trawl.plans.registry import query
from trawl.plans.splitsql import split_sql
from trawl.session import scratch_path
from trawl.sources.tables import read_table

# Fixed values of the registered queries
SIZE, OVERLAP = 500, 50
K = 3
THRESHOLD = 0.7
DIM = 64
DOC_URL = "https://docs.example.com/d/"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _chunks(spark, sf_dir):
    return CH.chunk_fixed(_docs(spark, sf_dir), SIZE, OVERLAP)


_TABLES: dict[tuple[str, str], str] = {}


def _embedded_chunks(spark, sf_dir):
    """The chunk table with its vectors, written once per application and read by all prompt queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        path = scratch_path(spark, "embedded-chunks")
        E.embed(_chunks(spark, sf_dir), "chunk_text", dim=DIM).write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def _questions(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


def _stub_model(prompts):
    """Stand-in for the language model in registered queries (deterministic)."""
    return prompts.str.len().map(lambda n: f"answer to a prompt of {n} characters")


# ------------------------------------------------------------ SQL pieces

STEP = SIZE - OVERLAP
SQL_CHUNKS = f"""chunks as (
  select doc_id, i as chunk_number, substring(text, i * {STEP} + 1, {SIZE}) as chunk_text
  from documents, unnest(range(0, greatest(0, cast(ceil((length(text) - {OVERLAP}) / {float(STEP)}) as integer) - 1) + 1)) as e(i)
  where text is not null)"""


def _bucket(tok):
    return f"cast(('0x' || substr(md5({tok}), 1, 8)) as bigint) % {DIM}"


SQL_CB = f"""ctok as (select doc_id, chunk_number, unnest(regexp_extract_all(lower(chunk_text), '{E.TOKEN_RX}')) as tok from chunks),
cb as (select doc_id, chunk_number, {_bucket('tok')} as b, count(*) as c from ctok group by all),
cn as (select doc_id, chunk_number, sqrt(sum(c * c)) as n from cb group by all)"""

SQL_Q = f"""q as (select conv_id, turn, text as question from conversations where role = 'user'),
qtok as (select conv_id, turn, unnest(regexp_extract_all(lower(question), '{E.TOKEN_RX}')) as tok
         from q where question is not null and trim(question) <> ''),
qb as (select conv_id, turn, {_bucket('tok')} as b, count(*) as c from qtok group by all),
qn as (select conv_id, turn, sqrt(sum(c * c)) as n from qb group by all)"""

SQL_SIM = """dots as (select qb.conv_id, qb.turn, cb.doc_id, cb.chunk_number, sum(qb.c * cb.c) as dot
         from qb join cb on qb.b = cb.b group by all),
sims as (select d.conv_id, d.turn, d.doc_id, d.chunk_number, d.dot / (qn.n * cn.n) as sim
         from dots d join qn using (conv_id, turn) join cn using (doc_id, chunk_number))"""


def _top(k, thr):
    where = f"where sim >= {thr}" if thr is not None else ""
    return f"""top as (select * from (
  select *, row_number() over (partition by conv_id, turn order by round(sim, 9) desc, doc_id, chunk_number) as rank
  from sims {where}) t where rank <= {k}),
ctx as (select conv_id, turn, string_agg(chunk_text, chr(10) || chr(10) order by rank) as context, count(*) as n_chunks
        from top join chunks using (doc_id, chunk_number) group by all)"""


# ------------------------------------------------------------ queries

@query("chunk_fixed", headline=True, oracle=f"""
with {SQL_CHUNKS} select doc_id, cast(chunk_number as integer) as chunk_number, chunk_text from chunks""")
def q_chunk_fixed(spark, sf_dir):
    """T8 (+ E1, C7, H15): 500-character windows with 50 overlap over every document."""
    return _chunks(spark, sf_dir)


@query("chunk_prefix", oracle=f"""
with {SQL_CHUNKS}
select doc_id, cast(chunk_number + 1 as integer) as chunk_number,
       'Content from page [' || cast(doc_id as varchar) || ']: ' || chunk_text as chunk_text from chunks""")
def q_chunk_prefix(spark, sf_dir):
    """H12 + E1: client-side chunk text with page prefix, 1-based numbers."""
    c = CH.chunk_fixed(_docs(spark, sf_dir), SIZE, OVERLAP, start=1)
    return CH.chunk_with_prefix(c, "doc_id")


@query("chunk_documents", headline=True, oracle=split_sql(5000, 500))
def q_chunk_documents(spark, sf_dir):
    """Recursive markdown splitting, server settings (5000 / 500), 0-based."""
    return CH.chunk_documents(_docs(spark, sf_dir), 5000, 500)


@query("chunk_documents_client", oracle=split_sql(512, 50, start=1))
def q_chunk_documents_client(spark, sf_dir):
    """Recursive markdown splitting, client settings (512 / 50), 1-based."""
    return CH.chunk_documents(_docs(spark, sf_dir), 512, 50, start=1)


def _cover_sql(size):
    """T7 at overlap 0: the chunks put together are the text, apart from white space, and none is too long."""
    return f"""select doc_id, regexp_replace(text, '\\s+', '', 'g') as letters, true as fits from documents
where text is not null and regexp_matches(text, '\\S')"""


def _cover(chunks, size):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_number", "chunk_text"))), lambda c: c["chunk_text"])
    return chunks.groupBy("doc_id").agg(
        F.regexp_replace(F.array_join(ordered, ""), r"\s+", "").alias("letters"),
        (F.max(F.length("chunk_text")) <= size).alias("fits"))


@query("chunk_cover", oracle=_cover_sql(5000))
def q_chunk_cover(spark, sf_dir):
    """What the server setting's chunks (no overlap) hold of every document."""
    return _cover(CH.chunk_documents(_docs(spark, sf_dir), 5000, 0), 5000)


@query("chunk_cover_client", oracle=_cover_sql(512))
def q_chunk_cover_client(spark, sf_dir):
    """The same for the client setting."""
    return _cover(CH.chunk_documents(_docs(spark, sf_dir), 512, 0, start=1), 512)


@query("chunk_cover_udtf", oracle=_cover_sql(512))
def q_chunk_cover_udtf(spark, sf_dir):
    """The same through the SQL table function."""
    from trawl.functions.sql import register
    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("trawl_documents")
    return _cover(spark.sql("select d.doc_id, c.chunk_number, c.chunk_text "
                            "from trawl_documents d, lateral chunk_text(d.text, 512, 0) c"), 512)


@query("embed", headline=True, oracle=f"""
with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{E.TOKEN_RX}')) as tok from documents where text is not null)
select doc_id, {_bucket('tok')} as bucket, count(*) as cnt from tok group by all""")
def q_embed(spark, sf_dir):
    """Token-hash vectors of every document, as non-zero (bucket, count) pairs."""
    v = E.embed(_docs(spark, sf_dir).select("doc_id", "text"), "text", dim=DIM)
    # posexplode_outer: a plain posexplode makes Catalyst infer size(vector) > 0
    # and push that filter below the repartition, evaluating the embedder twice
    ex = v.select("doc_id", F.posexplode_outer("vector").alias("bucket", "cnt"))
    return ex.where(F.col("cnt") > 0).select("doc_id", F.col("bucket").cast("long").alias("bucket"),
                                             F.col("cnt").cast("long").alias("cnt"))


def _buckets(vectors, *keys):
    """The non-zero (bucket, count) pairs of token-hash vectors; one row of nulls where there is no vector."""
    ex = vectors.select(*keys, F.posexplode_outer("vector").alias("bucket", "cnt"))
    return ex.where("cnt > 0 or cnt is null").select(*keys, F.col("bucket").cast("long").alias("bucket"),
                                                     F.col("cnt").cast("long").alias("cnt"))


@query("update_embeddings", oracle=f"""
with {SQL_CHUNKS},
tok as (select doc_id, chunk_number, unnest(regexp_extract_all(lower(chunk_text), '{E.TOKEN_RX}')) as tok from chunks)
select tok.doc_id, cast(chunk_number as integer) as chunk_number, {_bucket('tok')} as bucket, count(*) as cnt
from tok join documents d on tok.doc_id = d.doc_id where d.lang = 'en' group by all
union all
select c.doc_id, cast(chunk_number as integer), null, null from chunks c join documents d on c.doc_id = d.doc_id where d.lang <> 'en'""")
def q_update_embeddings(spark, sf_dir):
    """R2: refresh vectors of the chunks of English documents only."""
    docs = _docs(spark, sf_dir)
    ch = _chunks(spark, sf_dir).withColumn("vector", F.lit(None).cast("array<float>"))
    keys = docs.where(F.col("lang") == "en").select("doc_id")
    up = E.update_embeddings(ch, keys, key_col="doc_id", dim=DIM)
    return _buckets(up, "doc_id", "chunk_number")


@query("sync_content", oracle=f"""
with {SQL_CHUNKS},
tok as (select doc_id, chunk_number, unnest(regexp_extract_all(lower(chunk_text), '{E.TOKEN_RX}')) as tok from chunks)
select '{DOC_URL}' || cast(tok.doc_id as varchar) as source_id, cast(chunk_number as integer) as chunk_number,
       {_bucket('tok')} as bucket, count(*) as cnt
from tok join documents d on tok.doc_id = d.doc_id where d.lang <> 'en' group by all""")
def q_sync_content(spark, sf_dir):
    """Documents (as crawl log rows) without chunks are chunked and embedded;
    English ones are already chunked."""
    docs = _docs(spark, sf_dir).withColumn("url", F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string")))
    log = docs.select("url", F.col("text").alias("markdown"))
    have = CH.chunk_fixed(docs.where(F.col("lang") == "en").select(F.col("url").alias("source_id"), "text"),
                          SIZE, OVERLAP, key="source_id")
    new = RG.sync_content(log, have, lambda d: CH.chunk_fixed(d, SIZE, OVERLAP, key="source_id"), dim=DIM)
    return _buckets(new, "source_id", "chunk_number")


def _recrawled(spark, sf_dir):
    """Two crawls of all documents: the second finds French texts revised, German pages gone and the others as they were."""
    docs = _docs(spark, sf_dir).withColumn("url", F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string")))
    first = docs.select("url", F.col("text").alias("markdown"), F.lit(1).alias("ts"), F.lit("f").alias("file_name"))
    text = F.when(F.col("lang") == "fr", F.concat(F.lit("Revised. "), "text")).when(F.col("lang") != "de", F.col("text"))
    return first, docs.select("url", text.alias("markdown"), F.lit(2).alias("ts"), F.lit("f").alias("file_name"))


@query("chunk_versions", oracle=f"""
with revised as (select doc_id, case when lang = 'fr' then 'Revised. ' || text when lang <> 'de' then text end as text
                 from documents),
{SQL_CHUNKS.replace('from documents', 'from revised')}
select '{DOC_URL}' || cast(doc_id as varchar) as source_id, cast(chunk_number as integer) as chunk_number, chunk_text from chunks""")
def q_chunk_versions(spark, sf_dir):
    """R8 + R2: the chunks of a log whose texts changed: revised pages have new chunks, pages without a text have none."""
    first, second = _recrawled(spark, sf_dir)
    store = CV.ChunkStore(spark, scratch_path(spark, "chunk-store"),
                          lambda d: CH.chunk_fixed(d, SIZE, OVERLAP, key="source_id"), dim=DIM)
    store.sync(first)
    store.sync(first.unionByName(second))
    return store.chunks().select("source_id", "chunk_number", "chunk_text")


@query("orphan_chunks", oracle=f"""
with {SQL_CHUNKS}
select '{DOC_URL}' || cast(c.doc_id as varchar) as source_id, cast(c.chunk_number as integer) as chunk_number
from chunks c join documents d on c.doc_id = d.doc_id where d.lang = 'de'""")
def q_orphan_chunks(spark, sf_dir):
    """Chunks whose source is missing from the log (German documents are not logged)."""
    docs = _docs(spark, sf_dir).withColumn("url", F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string")))
    ch = CH.chunk_fixed(docs.select(F.col("url").alias("source_id"), "text"), SIZE, OVERLAP, key="source_id")
    log = docs.where(F.col("lang") != "de").select("url")
    return orphan_chunks(ch, log).select("source_id", "chunk_number")


@query("transcripts", oracle="""
select conv_id, string_agg(role || ': ' || text, chr(10) order by turn, role, text) as transcript, count(*) as turns
from conversations group by conv_id""")
def q_transcripts(spark, sf_dir):
    """Every conversation as ordered ``role: text`` lines."""
    return RG.transcripts(read_table(spark, sf_dir, "conversations"))


@query("build_prompts", headline=True, oracle=f"""
with {SQL_CHUNKS}, {SQL_CB}, {SQL_Q}, {SQL_SIM}, {_top(K, None)}
select q.conv_id, q.turn,
       case when context is not null then 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Query: ' || question end as prompt
from q left join ctx using (conv_id, turn)""")
def q_build_prompts(spark, sf_dir):
    """R3 (+ C6, E4, D12, R1, R7): top-3 chunks per user question -> context prompt."""
    p = RG.build_prompts(_questions(spark, sf_dir), _embedded_chunks(spark, sf_dir), K,
                         q_cols=("conv_id", "turn"), key_cols=("doc_id", "chunk_number"), dim=DIM)
    return p.select("conv_id", "turn", "prompt")


@query("answer_inputs", oracle=f"""
with {SQL_CHUNKS}, {SQL_CB}, {SQL_Q}, {SQL_SIM}, {_top(K, THRESHOLD)}
select q.conv_id, q.turn,
       '{RG.ANSWER_PREFIX}' || question ||
       case when context is not null then chr(10) || chr(10) || 'Using this context: ' || context else '' end as prompt,
       coalesce(n_chunks, 0) as n_chunks
from q left join ctx using (conv_id, turn)""")
def q_answer_inputs(spark, sf_dir):
    """R4 + H13 + B6: top-3 chunks with similarity >= 0.7; prompt with context only when found."""
    p = RG.answer_inputs(_questions(spark, sf_dir), _embedded_chunks(spark, sf_dir), K, THRESHOLD,
                         q_cols=("conv_id", "turn"), key_cols=("doc_id", "chunk_number"), dim=DIM)
    return p.select("conv_id", "turn", "prompt",
                    F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"))


@query("response_records", oracle=f"""
with {SQL_CHUNKS}, {SQL_CB}, {SQL_Q}, {SQL_SIM}, {_top(K, None)}
select q.conv_id, q.turn,
       case when context is null then '{RG.NO_CONTEXT}'
            else 'answer to a prompt of ' || cast(length('Context:' || chr(10) || context || chr(10) || chr(10) || 'Query: ' || question) as varchar) || ' characters'
       end as generated_response,
       coalesce(n_chunks, 0) as n_chunks, question as user_query, coalesce(context, '') as chunk_texts
from q left join ctx using (conv_id, turn)""")
def q_response_records(spark, sf_dir):
    """R5 + R6: prompts answered by a stand-in model; records with default texts."""
    p = RG.build_prompts(_questions(spark, sf_dir), _embedded_chunks(spark, sf_dir), K,
                         q_cols=("conv_id", "turn"), key_cols=("doc_id", "chunk_number"), dim=DIM)
    rec = RG.response_records(RG.complete(p, _stub_model))
    r = F.from_json("record", "generated_response string, chunks array<string>, user_query string")
    return rec.select("conv_id", "turn", r.alias("r")).select(
        "conv_id", "turn", "r.generated_response", F.size("r.chunks").cast("long").alias("n_chunks"), "r.user_query",
        F.array_join("r.chunks", "\n\n").alias("chunk_texts"))


@query("complete", oracle=f"""
with {SQL_CHUNKS}, {SQL_CB}, {SQL_Q}, {SQL_SIM}, {_top(K, None)}
select q.conv_id, q.turn,
       case when context is not null
            then 'answer to a prompt of ' || cast(length('Context:' || chr(10) || context || chr(10) || chr(10) || 'Query: ' || question) as varchar) || ' characters'
       end as response
from q left join ctx using (conv_id, turn)""")
def q_complete(spark, sf_dir):
    """An answer step over the prompt table (stand-in model)."""
    p = RG.build_prompts(_questions(spark, sf_dir), _embedded_chunks(spark, sf_dir), K,
                         q_cols=("conv_id", "turn"), key_cols=("doc_id", "chunk_number"), dim=DIM)
    return RG.complete(p, _stub_model).select("conv_id", "turn", "response")


# ------------------------------------------------------------ vector queries on embeddings

def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _cos(a, b):
    return f"list_cosine_similarity(({a})::DOUBLE[], ({b})::DOUBLE[])"


_NEAREST3 = f"""
with s as (select q.vec_id as q_id, c.vec_id, {_cos('c.embedding', 'q.embedding')} as sim
           from embeddings q, embeddings c)
select q_id, vec_id, round(sim, 6) as similarity, cast(rank as integer) as rank from (
  select *, row_number() over (partition by q_id order by round(sim, 9) desc, vec_id) as rank from s) t
where rank <= 3"""


@query("similar_chunks_batch", headline=True, oracle=_NEAREST3)
def q_similar_chunks_batch(spark, sf_dir):
    """C6 + E4: every vector's 3 nearest vectors by cosine (batch retrieval)."""
    emb = _emb(spark, sf_dir)
    qs = emb.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qvec"))
    r = RT.similar_chunks_batch(emb, qs, 3, None, key_cols=("vec_id",), vector_col="embedding")
    return r.select("q_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("similar_chunks_indexed", oracle=_NEAREST3)
def q_similar_chunks_indexed(spark, sf_dir):
    """C6 + E4: the same through an index of clustered tiles, pruned by the bounds of the tiles."""
    emb = _emb(spark, sf_dir)
    qs = emb.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qvec"))
    index = VI.build_index(emb, key_cols=("vec_id",), vector_col="embedding")
    r = VI.search_index(index, qs, 3, key_cols=("vec_id",), chunks=emb)
    return r.select("q_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_TOP3 = f"""
with q as (select embedding as qv from embeddings where vec_id = 0),
s as (select e.vec_id, {_cos('e.embedding', 'q.qv')} as sim from embeddings e, q)
select vec_id, round(sim, 6) as similarity from s order by round(sim, 9) desc, vec_id limit 3"""


@query("top_chunks", oracle=_TOP3)
def q_top_chunks(spark, sf_dir):
    """top-3 by cosine, no threshold."""
    emb = _emb(spark, sf_dir)
    qv = emb.where(F.col("vec_id") == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qvec"))
    r = RT.top_chunks(emb, qv, 3, key_cols=("vec_id",), vector_col="embedding", payload_cols=())
    return r.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("similar_chunks_expr", oracle=_TOP3)
def q_similar_chunks_expr(spark, sf_dir):
    """C5 + H19: the same top-3 as a broadcast join with the cosine as a SQL expression."""
    emb = _emb(spark, sf_dir)
    qv = emb.where(F.col("vec_id") == 0).select(as_vector("embedding", 64).alias("qvec"))
    r = RT.similar_chunks_sql(emb, qv, 3, None, key_cols=("vec_id",), vector_col="embedding")
    return r.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("relevant_chunks", oracle=f"""
with {SQL_CHUNKS}, {SQL_CB},
qt as (select unnest(regexp_extract_all(lower(text), '{E.TOKEN_RX}')) as tok from benchmark where item_id = 0),
qb as (select {_bucket('tok')} as b, count(*) as c from qt group by all),
qn as (select sqrt(sum(c * c)) as n from qb),
d as (select cb.doc_id, cb.chunk_number, sum(qb.c * cb.c) as dot from qb join cb on qb.b = cb.b group by all),
s as (select d.doc_id, d.chunk_number, d.dot / (qn.n * cn.n) as sim from d join cn using (doc_id, chunk_number), qn),
t as (select s.*, chunk_text from s join chunks using (doc_id, chunk_number)
      order by round(sim, 9) desc, doc_id, chunk_number limit 5)
select to_json(list({{'chunk': chunk_text, 'score': round(sim, 6)}} order by round(sim, 9) desc, doc_id, chunk_number))::varchar as chunks_json
from t""")
def q_relevant_chunks(spark, sf_dir):
    """F3 + A6: top-5 chunks for one question (benchmark item 0) as a JSON list of {chunk, score}."""
    b = read_table(spark, sf_dir, "benchmark").where(F.col("item_id") == 0)
    qv = E.embed(b.select(F.col("item_id").alias("q_id"), "text"), "text", dim=DIM, out_col="qvec")
    return RT.relevant_chunks(_embedded_chunks(spark, sf_dir), qv.select("q_id", "qvec"), 5,
                              decimals=6, key_cols=("doc_id", "chunk_number"))


@query("cosine_sql", oracle=_TOP3)
def q_cosine_sql(spark, sf_dir):
    """H19 for SQL users: the registered ``cosine_similarity`` SQL function."""
    from trawl.functions.sql import register
    register(spark)
    _emb(spark, sf_dir).createOrReplaceTempView("trawl_embeddings")
    return spark.sql("""
        select vec_id, round(sim, 6) as similarity from (
          select vec_id, cosine_similarity(embedding, qv) as sim from (
            select vec_id, embedding, (select embedding from trawl_embeddings where vec_id = 0) as qv
            from trawl_embeddings) e) s
        order by round(sim, 9) desc, vec_id limit 3""")


@query("chunk_texts_inline", oracle=split_sql(512, 50))
def q_chunk_texts_inline(spark, sf_dir):
    """T7 for SQL users, whole Arrow batches at a time: ``inline(chunk_texts(...))`` over every document."""
    from trawl.functions.sql import register
    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("trawl_documents")
    return spark.sql("select doc_id, chunk_number, chunk_text from trawl_documents "
                     "lateral view inline(chunk_texts(text, 512, 50)) c as chunk_number, chunk_text")


@query("chunk_text_udtf", oracle=split_sql(5000, 500))
def q_chunk_text_udtf(spark, sf_dir):
    """T7 for SQL users: the ``chunk_text`` table function over every document."""
    from trawl.functions.sql import register
    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("trawl_documents")
    return spark.sql("select d.doc_id, c.chunk_number, c.chunk_text "
                     "from trawl_documents d, lateral chunk_text(d.text, 5000, 500) c")

"""Registered queries: terms, vectors, retrieval, contexts, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import chunking, cleaning, lexical, pagination, postings, retrieval
from leafmill.plans import inputs as i
from leafmill.plans.inputs import tokens_sql, trim_sql, with_ctes
from leafmill.session import stage_table, table

QUERIES = {}
ORACLES = {}

DIM = 64


# ---- terms and vectors ----------------------------------------------------------------------------------------------


def terms_sql(chunks: str = "chunks", name: str = "terms") -> str:
    return f"""{name}_tokens AS (
  SELECT doc_id, chunk_id, len(ts)::INTEGER AS n_tokens, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos
  FROM (SELECT doc_id, chunk_id, {tokens_sql('text')} AS ts FROM {chunks})),
{name} AS (
  SELECT doc_id, chunk_id, term, count(*) AS tf, min(pos)::INTEGER AS first_pos, min(n_tokens) AS n_tokens
  FROM {name}_tokens GROUP BY doc_id, chunk_id, term)"""


def vocab_sql(dim: int, chunks: str = "chunks", name: str = "vocab") -> str:
    return f"""{name}_sizes AS (SELECT doc_id, count(*) AS n_texts FROM {chunks} GROUP BY doc_id),
{name} AS (
  SELECT doc_id, term, df, n_texts, idx::INTEGER AS idx FROM (
    SELECT t.doc_id, t.term, count(*) AS df, s.n_texts, row_number() OVER (
      PARTITION BY t.doc_id ORDER BY count(*) DESC, min(t.chunk_id * 1000000 + t.first_pos)) - 1 AS idx
    FROM terms t JOIN {name}_sizes s USING (doc_id) GROUP BY t.doc_id, t.term, s.n_texts HAVING count(*) <= s.n_texts * 0.9)
  WHERE idx < {dim})"""


def weights_sql(name: str = "weights") -> str:
    return f"""{name}_raw AS (
  SELECT t.doc_id, t.chunk_id, v.idx, t.term, t.tf / t.n_tokens * ln(v.n_texts / v.df) AS w
  FROM terms t JOIN vocab v USING (doc_id, term)),
{name} AS (
  SELECT doc_id, chunk_id, idx, term,
         w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, chunk_id)) AS weight FROM {name}_raw)"""


VECTOR_CTES = ",\n".join([i.small_chunks_sql(), terms_sql(), vocab_sql(DIM), weights_sql()])

QUERIES["chunk_terms"] = lambda s, d: lexical.chunk_terms(i.small_chunks(s, d))
ORACLES["chunk_terms"] = with_ctes(i.small_chunks_sql() + ",\n" + terms_sql(), "SELECT * FROM terms")


def _vocab(chunks: DataFrame) -> DataFrame:
    return lexical.vocab_topn(lexical.chunk_terms(chunks), chunks, DIM)


QUERIES["vocab_topn"] = lambda s, d: _vocab(i.small_chunks(s, d))
ORACLES["vocab_topn"] = with_ctes([i.small_chunks_sql(), terms_sql(), vocab_sql(DIM)], "SELECT * FROM vocab")


def _weights(s, d):
    chunks = i.small_chunks(s, d)
    terms = lexical.chunk_terms(chunks)
    return lexical.tfidf_weights(terms, lexical.vocab_topn(terms, chunks, DIM), weigh=chunks).withColumn("weight", F.round("weight", 6))


QUERIES["tfidf_weights"] = _weights
ORACLES["tfidf_weights"] = with_ctes(
    VECTOR_CTES, "SELECT doc_id, chunk_id, idx, term, round(weight, 6) AS weight FROM weights"
)


def _vectors(s, d):
    return lexical.tfidf_vectors(i.small_chunks(s, d), DIM).select(
        "doc_id",
        "chunk_id",
        F.size("embedding").alias("dim"),
        F.array_join(F.transform(F.filter("embedding", lambda v: v > 0), lambda v: F.round(v * 1000).cast("int").cast("string")), ",").alias("cells"),
    )


QUERIES["tfidf_vectors"] = _vectors
ORACLES["tfidf_vectors"] = with_ctes(
    VECTOR_CTES,
    f"""SELECT c.doc_id, c.chunk_id, {DIM} AS dim,
  coalesce(string_agg(CAST(round(w.weight * 1000)::INTEGER AS VARCHAR), ',' ORDER BY w.idx), '') AS cells
FROM chunks c LEFT JOIN weights w USING (doc_id, chunk_id) GROUP BY c.doc_id, c.chunk_id""",
)


def _embedding_source(s, d):
    """A first model that covers chunks shorter than 880 characters only, a second one for documents in English."""
    chunks = i.small_chunks(s, d)
    lang = i.documents(s, d).select("doc_id", "lang")
    size = F.length("text").cast("double")
    first = chunks.filter(F.length("text") < 880).select("doc_id", "chunk_id", F.array(size).alias("embedding"))
    second = chunks.join(lang, "doc_id").filter("lang = 'en'").select(
        "doc_id", "chunk_id", F.array(size, size * 2).alias("embedding")
    )
    out = lexical.embedding_source(chunks, [("short", first), ("english", second)])
    return out.select("doc_id", "chunk_id", "provider", F.size("embedding").alias("dim"), F.try_element_at("embedding", F.lit(-1)).alias("last_cell"))


QUERIES["embedding_source"] = _embedding_source
ORACLES["embedding_source"] = with_ctes(
    i.small_chunks_sql(),
    """, cover AS (
  SELECT doc_id, bool_and(length(text) < 880) AS short FROM chunks GROUP BY doc_id)
SELECT c.doc_id, c.chunk_id,
  CASE WHEN v.short THEN 'short' WHEN d.lang = 'en' THEN 'english' ELSE 'none' END AS provider,
  CASE WHEN v.short THEN 1 WHEN d.lang = 'en' THEN 2 ELSE 0 END AS dim,
  CASE WHEN v.short THEN length(c.text)::DOUBLE WHEN d.lang = 'en' THEN 2 * length(c.text)::DOUBLE END AS last_cell
FROM chunks c JOIN cover v USING (doc_id) JOIN documents d USING (doc_id)""",
)


# ---- ranking --------------------------------------------------------------------------------------------------------


def questions(s, d) -> DataFrame:
    """One question per document: its last 200 characters."""
    start = F.greatest(F.length("text") - 199, F.lit(1))
    return i.documents(s, d).select(
        F.col("doc_id").alias("query_id"), "doc_id", F.substring(F.col("text"), start, F.lit(200)).alias("question")
    )


QUESTIONS_SQL = """questions AS (
  SELECT doc_id AS query_id, doc_id, substring(text, greatest(length(text) - 199, 1), 200) AS question FROM documents)"""


def _cosine(s, d):
    """Each label's mean vector against the vectors of that label."""
    vectors = table(s, d, "embeddings").select(F.col("label").alias("doc_id"), "vec_id", "embedding")
    cells = vectors.select("doc_id", F.posexplode("embedding").alias("pos", "v"))
    mean = cells.groupBy("doc_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    queries = mean.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c")).select(
        F.col("doc_id").alias("query_id"), "doc_id", F.col("c.m").alias("embedding")
    )
    top = retrieval.cosine_topk(queries, vectors, item="vec_id")
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


QUERIES["cosine_topk"] = _cosine
ORACLES["cosine_topk"] = """WITH cells AS (
  SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
mean AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS m FROM cells GROUP BY label, pos) GROUP BY label),
scored AS (
  SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], m.c) AS score
  FROM embeddings e JOIN mean m USING (label))
SELECT label AS query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score >= 0.1)
WHERE rank <= 5"""


def _hybrid(s, d, query_vocab):
    chunks = i.small_chunks(s, d)
    terms = lexical.chunk_terms(chunks)
    vocab = stage_table(lexical.vocab_topn(terms, chunks, DIM))
    asked = lexical.query_vectors(questions(s, d), vocab, DIM, query_vocab)
    top = retrieval.hybrid_topk(asked, lexical.tfidf_vectors(chunks, DIM, terms=terms, vocab=vocab), 3, weigh=chunks)
    return top.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("score", "embedding_score", "keyword_score")])


def hybrid_sql(query_vocab: str) -> str:
    embedded = "0.0" if query_vocab == "alone" else "coalesce(e.dot, 0.0)"
    return with_ctes(
        [VECTOR_CTES, QUESTIONS_SQL],
        f""", words AS (
  SELECT query_id, doc_id, unnest(ts) AS term, len(ts) AS n FROM (SELECT *, {tokens_sql('question')} AS ts FROM questions)),
qraw AS (
  SELECT w.query_id, w.doc_id, v.idx, count(*) / any_value(w.n) * ln(any_value(v.n_texts) / any_value(v.df)) AS w
  FROM words w JOIN vocab v USING (doc_id, term) GROUP BY w.query_id, w.doc_id, v.idx),
qvec AS (SELECT query_id, doc_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qraw),
emb AS (
  SELECT q.query_id, x.chunk_id, sum(q.w * x.weight) AS dot
  FROM qvec q JOIN weights x USING (doc_id, idx) GROUP BY q.query_id, x.chunk_id),
kw AS (
  SELECT w.query_id, t.chunk_id, count(*) / any_value(w.n) AS score
  FROM words w JOIN terms t USING (doc_id, term) GROUP BY w.query_id, t.chunk_id),
scored AS (
  SELECT q.query_id, c.chunk_id, {embedded} AS embedding_score, coalesce(k.score, 0.0) AS keyword_score,
         {embedded} * 0.7 + coalesce(k.score, 0.0) * (1 - 0.7) AS score
  FROM questions q JOIN chunks c USING (doc_id)
  LEFT JOIN emb e ON e.query_id = q.query_id AND e.chunk_id = c.chunk_id
  LEFT JOIN kw k ON k.query_id = q.query_id AND k.chunk_id = c.chunk_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM scored),
flagged AS (
  SELECT *, bool_or(chunk_id = 0 AND r <= 3) OVER (PARTITION BY query_id) AS has_zero,
         least(3, count(*) OVER (PARTITION BY query_id)) AS size FROM ranked)
SELECT query_id, chunk_id, round(score::DOUBLE, 6) AS score, round(embedding_score::DOUBLE, 6) AS embedding_score,
  round(keyword_score::DOUBLE, 6) AS keyword_score
FROM flagged WHERE (r <= 3 AND (has_zero OR r < size)) OR (NOT has_zero AND chunk_id = 0)""",
    )


def _hybrid_listed(s, d):
    """Ranked over block-max posting lists; hybrid_topk_vectors does the same over dense vectors."""
    chunks = i.small_chunks(s, d)
    terms = lexical.chunk_terms(chunks)
    vocab = stage_table(lexical.vocab_topn(terms, chunks, DIM))
    queries = stage_table(questions(s, d))
    asked = stage_table(postings.query_terms(queries, vocab))
    lists = stage_table(postings.posting_blocks(terms, vocab, asked, weigh=chunks))
    top = postings.hybrid_topk_postings(asked, lists, chunks, queries, 3)
    return top.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("score", "embedding_score", "keyword_score")])


QUERIES["hybrid_topk"] = _hybrid_listed
ORACLES["hybrid_topk"] = hybrid_sql("corpus")
QUERIES["hybrid_topk_vectors"] = lambda s, d: _hybrid(s, d, "corpus")
ORACLES["hybrid_topk_vectors"] = hybrid_sql("corpus")
QUERIES["hybrid_topk_keyword_only"] = lambda s, d: _hybrid(s, d, "alone")
ORACLES["hybrid_topk_keyword_only"] = hybrid_sql("alone")


def _keyword(s, d, k=3):
    chunks = i.small_chunks(s, d)
    asked = questions(s, d)
    return retrieval.keyword_topk(asked, lexical.chunk_terms(chunks, asked=retrieval.question_words(asked)), chunks, k), chunks


def keyword_sql(k: int, name: str = "top") -> str:
    return f"""{name}_words AS (
  SELECT query_id, doc_id, unnest({tokens_sql('question')}) AS term FROM questions),
{name}_scored AS (
  SELECT q.query_id, q.doc_id, c.chunk_id, coalesce(sum(t.tf), 0)::BIGINT AS score
  FROM questions q JOIN chunks c USING (doc_id)
  LEFT JOIN (SELECT w.query_id, t.chunk_id, t.tf FROM {name}_words w JOIN terms t USING (doc_id, term)) t
    ON t.query_id = q.query_id AND t.chunk_id = c.chunk_id
  GROUP BY q.query_id, q.doc_id, c.chunk_id),
{name}_flagged AS (
  SELECT *, bool_or(chunk_id = 0 AND r <= {k}) OVER (PARTITION BY query_id) AS has_zero FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {name}_scored)),
{name} AS (
  SELECT query_id, doc_id, chunk_id, CASE WHEN NOT has_zero AND chunk_id = 0 THEN 0 ELSE score END AS score
  FROM {name}_flagged WHERE (r <= {k} AND (has_zero OR r < {k})) OR (NOT has_zero AND chunk_id = 0))"""


KEYWORD_CTES = ",\n".join([i.small_chunks_sql(), terms_sql(), QUESTIONS_SQL, keyword_sql(3)])

QUERIES["keyword_topk"] = lambda s, d: _keyword(s, d)[0]
ORACLES["keyword_topk"] = with_ctes(KEYWORD_CTES, "SELECT * FROM top")


def _ranked(s, d):
    top, chunks = _keyword(s, d)
    return retrieval.attach_text(top, chunks)


def context_sql(max_chars: int, partial: bool, ranked: str = "ranked", name: str = "ctx") -> str:
    """Recursive: one retrieved chunk per step, exactly as a reader would append them."""
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    over = f"length(f.ctx) + length(n.text) > {max_chars}"
    cut = (
        f"CASE WHEN {max_chars} - length(f.ctx) - 10 > 200 THEN f.ctx || substring(n.text, 1, {max_chars} - length(f.ctx) - 10) || '...' || {sep} ELSE f.ctx END"
        if partial
        else "f.ctx"
    )
    return f"""{name}_rows AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS i FROM {ranked}),
{name}_fold AS (
  SELECT DISTINCT query_id, 0::BIGINT AS i, '' AS ctx, false AS stopped FROM {name}_rows
  UNION ALL
  SELECT n.query_id, n.i, CASE WHEN f.stopped THEN f.ctx WHEN {over} THEN {cut} ELSE f.ctx || n.text || {sep} END,
         f.stopped OR {over}
  FROM {name}_fold f JOIN {name}_rows n ON n.query_id = f.query_id AND n.i = f.i + 1),
{name} AS (SELECT query_id, {trim_sql('arg_max(ctx, i)')} AS context FROM {name}_fold GROUP BY query_id)"""


RANKED_SQL = """ranked AS (
  SELECT t.query_id, t.doc_id, t.chunk_id, t.score, c.text, c.pages FROM top t JOIN chunks c USING (doc_id, chunk_id))"""

for _name, _partial in (("pack_context", False), ("pack_context_partial", True)):
    QUERIES[_name] = lambda s, d, p=_partial: retrieval.pack_context(_ranked(s, d), 1900, p)
    ORACLES[_name] = with_ctes([KEYWORD_CTES, RANKED_SQL, context_sql(1900, _partial)], "SELECT query_id, context FROM ctx")

QUERIES["retrieval_report"] = lambda s, d: retrieval.retrieval_report(_ranked(s, d)).select(
    "query_id",
    F.array_join(
        F.transform("retrieved", lambda r: F.concat_ws("/", r["chunk_id"].cast("string"), F.array_join(r["pages"].cast("array<string>"), "+"), r["score"].cast("string"), r["preview"])),
        "|",
    ).alias("retrieved"),
)
ORACLES["retrieval_report"] = with_ctes(
    [KEYWORD_CTES, RANKED_SQL],
    """SELECT query_id, string_agg(chunk_id || '/' || array_to_string(pages, '+') || '/' || score || '/' || substring(text, 1, 150), '|' ORDER BY chunk_id) AS retrieved
FROM ranked GROUP BY query_id""",
)


# ---- contexts for question writing, history, prompts ----------------------------------------------------------------

QUERIES["sample_context"] = lambda s, d: retrieval.sample_context(i.small_chunks(s, d), budget=3000)
ORACLES["sample_context"] = with_ctes(
    i.small_chunks_sql(),
    f""", walk AS (
  SELECT doc_id, -1 AS chunk_id, '' AS ctx, false AS stopped FROM chunks WHERE chunk_id = 0
  UNION ALL
  SELECT c.doc_id, c.chunk_id,
         CASE WHEN w.stopped OR length(w.ctx) + length(c.text) + 2 > 3000 THEN w.ctx
              WHEN w.ctx = '' THEN c.text ELSE w.ctx || chr(10) || chr(10) || c.text END,
         w.stopped OR length(w.ctx) + length(c.text) + 2 > 3000
  FROM walk w JOIN chunks c ON c.doc_id = w.doc_id AND c.chunk_id = w.chunk_id + 1)
SELECT doc_id, arg_max(ctx, chunk_id) AS context FROM walk GROUP BY doc_id""",
)

QUERIES["sample_context_pages"] = lambda s, d: retrieval.sample_context(
    retrieval.chunks_or_pages(i.small_chunks(s, d).filter("doc_id % 2 = 0").withColumn("chunk_id", F.col("chunk_id") * 7000), i.doc_pages(s, d, 900)), budget=880
)
ORACLES["sample_context_pages"] = with_ctes(
    [i.small_chunks_sql(), i.doc_pages_sql(size=900)],
    f"""SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY k) FILTER (WHERE used <= 880), '') AS context FROM (
  SELECT doc_id, k, text, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY k) - CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1 THEN 0 ELSE 2 END AS used FROM (
    SELECT doc_id, chunk_id AS k, {trim_sql('text')} AS text FROM chunks WHERE doc_id % 2 = 0
    UNION ALL
    SELECT doc_id, page, '[Page ' || page || ']' || chr(10) || {trim_sql('text')} FROM doc_pages
    WHERE {trim_sql('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id % 2 = 0)) WHERE {trim_sql('text')} <> '')
GROUP BY doc_id""",
)


def _sampled(s, d):
    topics = i.documents(s, d).select("doc_id", F.substring_index("text", " ", -1).alias("topic"))
    return retrieval.sample_context(i.small_chunks(s, d), topics, budget=4000, sampled=True)


QUERIES["sample_context_by_topic"] = _sampled
ORACLES["sample_context_by_topic"] = with_ctes(
    i.small_chunks_sql(),
    """, sizes AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
needle AS (SELECT doc_id, lower(string_split(text, ' ')[-1]) AS topic FROM documents),
hit AS (
  SELECT c.doc_id, c.chunk_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_id) AS h
  FROM chunks c JOIN needle x USING (doc_id) WHERE length(x.topic) > 2 AND contains(lower(c.text), x.topic)),
tiers AS (
  SELECT c.doc_id, c.chunk_id, c.text, CASE WHEN h.h <= 8 THEN 0 WHEN c.chunk_id = 0 THEN 1
    WHEN c.chunk_id IN (SELECT floor(k * s.n / least(6, s.n)) FROM range(1, 5) r(k) WHERE k < least(6, s.n) - 1) THEN 2
    WHEN c.chunk_id = s.n - 1 THEN 3 ELSE 4 END AS tier
  FROM chunks c JOIN sizes s USING (doc_id) LEFT JOIN hit h ON h.doc_id = c.doc_id AND h.chunk_id = c.chunk_id),
placed AS (
  SELECT *, sum(length(text) + 2) OVER w AS used, row_number() OVER w AS r
  FROM tiers WINDOW w AS (PARTITION BY doc_id ORDER BY tier, chunk_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_id) AS context
FROM placed WHERE CASE WHEN r = 1 THEN used ELSE used - 2 END <= 4000 GROUP BY doc_id""",
)


def _history(s, d):
    return retrieval.history_window(table(s, d, "conversations"), 3)


QUERIES["history_window"] = _history
HISTORY_SQL = """history AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
  WHERE r <= 3 AND role <> '' AND text <> '')"""
ORACLES["history_window"] = with_ctes(HISTORY_SQL, "SELECT * FROM history")

QUERIES["history_all"] = lambda s, d: retrieval.history_window(table(s, d, "conversations"), None)
ORACLES["history_all"] = """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text AS content
FROM conversations WHERE role <> '' AND text <> ''"""


def _prompts(s, d):
    asked = questions(s, d).withColumn("conv_id", F.col("doc_id"))
    contexts = retrieval.pack_context(_ranked(s, d), 1900, True)
    docs = i.documents(s, d)
    meta = docs.select(
        "doc_id",
        F.concat("source", F.lit("-"), "lang").alias("filename"),
        F.when(F.col("lang") == "fr", "epub").otherwise("pdf").alias("file_type"),
        F.ceil(F.length("text") / 400).cast("int").alias("total_pages"),
        (F.col("lang") == "de").alias("has_scanned_content"),
    )
    out = retrieval.build_prompts(asked, contexts, _history(s, d), meta)
    return out.select(
        "query_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n##\n").alias("messages")
    )


QUERIES["build_prompts"] = _prompts
ORACLES["build_prompts"] = with_ctes(
    [KEYWORD_CTES, RANKED_SQL, context_sql(1900, True), HISTORY_SQL],
    """, past AS (
  SELECT conv_id, string_agg(role || ': ' || content, chr(10) || '##' || chr(10) ORDER BY turn) || chr(10) || '##' || chr(10) AS past
  FROM history GROUP BY conv_id)
SELECT q.query_id,
  'system: Answer questions about this ' || CASE d.lang WHEN 'fr' THEN 'epub' ELSE 'pdf' END
  || ' from the given sections only and cite each ' || u.unit || ' as (' || u.cap || ' N). Document: "' || d.source || '-' || d.lang
  || '", ' || ceil(length(d.text) / 400.0)::INTEGER || ' ' || u.unit || 's'
  || CASE d.lang WHEN 'de' THEN ' (some pages were OCR-processed)' ELSE '' END || '.' || chr(10) || '##' || chr(10)
  || coalesce(p.past, '') || 'user: Relevant document sections:' || chr(10) || '---' || chr(10) || x.context || chr(10)
  || '---' || chr(10) || chr(10) || 'Question: ' || q.question AS messages
FROM questions q JOIN documents d USING (doc_id)
JOIN (VALUES (true, 'chapter', 'Chapter'), (false, 'page', 'Page')) u(epub, unit, cap) ON u.epub = (d.lang = 'fr')
JOIN ctx x USING (query_id) LEFT JOIN past p ON p.conv_id = q.doc_id""",
)


def _flagship(s, d):
    """Documents -> pages -> cleaned -> chunks -> term index -> keyword ranking -> contexts."""
    cleaned = stage_table(cleaning.clean_pages(pagination.paginate_fixed(i.documents(s, d))))
    chunks = stage_table(chunking.chunk_pages(cleaning.drop_repeated_lines(cleaned)))
    asked = questions(s, d)
    top = retrieval.keyword_topk(asked, lexical.chunk_terms(chunks, asked=retrieval.question_words(asked)), chunks)
    return retrieval.pack_context(retrieval.attach_text(top, chunks))


QUERIES["keyword_context"] = _flagship


def _flagship_sql() -> str:
    from leafmill.plans.page_queries import clean_sql

    cleaned = f"clean AS (SELECT doc_id, page, {clean_sql('text')} AS text FROM doc_pages)"
    # no page of these documents repeats a line on 60 % of its pages: checked by the query on books instead
    lines = f"""page_lines AS (
  SELECT DISTINCT doc_id, page, {trim_sql('l')} AS t FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS l FROM clean)),
furniture AS (
  SELECT p.doc_id, p.t FROM page_lines p JOIN (SELECT doc_id, count(*) AS n FROM clean GROUP BY doc_id) s USING (doc_id)
  WHERE length(p.t) > 3 AND s.n >= 3 GROUP BY p.doc_id, p.t, s.n HAVING count(*) >= greatest(3, ceil(s.n * 0.6))),
refined AS (
  SELECT c.doc_id, c.page, array_to_string(list_filter(string_split(c.text, chr(10)),
    lambda x: NOT list_contains(coalesce(f.ts, []), {trim_sql('x')})), chr(10)) AS text
  FROM clean c LEFT JOIN (SELECT doc_id, list(t) AS ts FROM furniture GROUP BY doc_id) f USING (doc_id))"""
    return with_ctes(
        [i.doc_pages_sql(), cleaned, lines, i.chunks_sql("refined", 4800), terms_sql(), QUESTIONS_SQL, keyword_sql(6), RANKED_SQL, context_sql(12000, False)],
        "SELECT query_id, context FROM ctx",
    )


ORACLES["keyword_context"] = _flagship_sql()

"""Scoring chunks against questions, and packing the winners into contexts and prompts.

Questions join the chunks of their own document by `doc_id`. The question side is small per document, so it is copied
over salts while the chunks of a hot document spread. Top-k is `row_number <= k`, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.blocks import block_join, block_of, number_rows, prefix_sums, spread_join
from leafmill.functions.text import PAGE_JOINER, clip, nonempty, tokens_of, trim_ws
from leafmill.functions.vectors import cosine, norm
from leafmill.session import stage_table

# Fixed values.
SIMILAR_TOP_K = 5
SIMILAR_MIN_SCORE = 0.1
CHAT_TOP_K = 6
EMBEDDING_SHARE = 0.7
KEYWORD_CONTEXT_CHARS = 12_000
CHAT_CONTEXT_CHARS = 14_000
CONTEXT_SEPARATOR = "\n\n---\n\n"
PARTIAL_MARGIN = 10
PARTIAL_MIN_CHARS = 200
HISTORY_MESSAGES = 10
PREVIEW_CHARS = 150


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, k: int = SIMILAR_TOP_K, min_score: float = SIMILAR_MIN_SCORE, item: str = "chunk_id"
) -> DataFrame:
    """(query_id, item, score, rank): best items of the query's document, at least `min_score`."""
    wanted = queries.select("query_id", "doc_id", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_qn"))
    scored = spread_join(vectors.select("doc_id", item, "embedding"), wanted, ["doc_id"], F.col(item)).select(
        "query_id", "doc_id", item, cosine(F.col("_q"), F.col("embedding"), norm_a=F.col("_qn")).alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))
    return scored.filter(F.col("score") >= min_score).withColumn("rank", rank).filter(F.col("rank") <= k)


def with_first(scored: DataFrame, k: int, first_score: Column) -> DataFrame:
    """Top k by score then chunk order, where chunk 0 takes the last place if it is not already in."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    # rank restarts over at most k rows of a query here
    per_query = Window.partitionBy("query_id")
    zero_in = F.max((F.col("chunk_id") == 0).cast("int")).over(per_query) == 1
    size = F.count(F.lit(1)).over(per_query)
    marked = top.withColumn("keep", zero_in | (F.col("rank") < size)).filter("keep").drop("keep")
    zeros = scored.filter(F.col("chunk_id") == 0).withColumn("score", first_score).withColumn("rank", F.lit(k + 1))
    merged = marked.unionByName(zeros)
    again = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))
    return merged.withColumn("_n", again).filter("_n = 1").drop("_n", "rank")


def hybrid_topk(
    queries: DataFrame, chunks: DataFrame, k: int = CHAT_TOP_K, embedding_share: float = EMBEDDING_SHARE, weigh: DataFrame | None = None
) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, embedding_score, keyword_score) in chunk order per query.

    `queries` has (query_id, doc_id, question, embedding); `chunks` has (doc_id, chunk_id, text, embedding).
    `weigh` is a table with the same documents that is cheaper to count than `chunks`.
    """
    wanted = queries.select(
        "query_id",
        "doc_id",
        tokens_of(F.col("question")).alias("_words"),
        F.col("embedding").alias("_q"),
        norm(F.col("embedding")).alias("_qn"),
    )
    terms = F.array_distinct(tokens_of(F.col("text")))
    lean = chunks.select("doc_id", "chunk_id", "embedding", norm(F.col("embedding")).alias("_n"), terms.alias("_terms"))
    pairs = spread_join(lean, wanted, ["doc_id"], F.col("chunk_id"), weigh=weigh)
    hits = F.size(F.filter("_words", lambda w: F.array_contains(F.col("_terms"), w)))
    keyword = F.when(F.size("_words") > 0, hits / F.size("_words")).otherwise(0.0)
    scored = pairs.select(
        "query_id",
        "doc_id",
        "chunk_id",
        cosine(F.col("_q"), F.col("embedding"), F.col("_qn"), F.col("_n")).alias("embedding_score"),
        keyword.alias("keyword_score"),
    ).withColumn(
        "score", F.col("embedding_score") * embedding_share + F.col("keyword_score") * (1 - embedding_share)
    )
    # read by two branches: six numbers a chunk are written, so that no vector is made again
    return with_first(stage_table(scored), k, F.col("score"))


def question_words(queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, times): the words of the questions."""
    return (
        queries.select("query_id", "doc_id", F.explode(tokens_of(F.col("question"))).alias("term"))
        .groupBy("query_id", "doc_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def keyword_topk(queries: DataFrame, terms: DataFrame, chunks: DataFrame, k: int = CHAT_TOP_K) -> DataFrame:
    """(query_id, doc_id, chunk_id, score): summed term counts through an inverted-index join.

    Of `terms` only those of the questions are read. Chunks without any hit can only fill the places left over, in chunk order, so the k chunks of a document with the
    smallest ids are enough to complete the ranking exactly.
    """
    words = question_words(queries)
    hits = (
        words.join(terms.select("doc_id", "chunk_id", "term", "tf"), ["doc_id", "term"])
        .groupBy("query_id", "doc_id", "chunk_id")
        .agg(F.sum(F.col("tf") * F.col("times")).alias("score"))
    )
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    leading = chunks.select("doc_id", "chunk_id").withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")
    fill = leading.join(queries.select("query_id", "doc_id"), "doc_id")
    scored = (
        hits.unionByName(fill.withColumn("score", F.lit(0).cast("bigint")))
        .groupBy("query_id", "doc_id", "chunk_id")
        .agg(F.max("score").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    per_query = Window.partitionBy("query_id")
    zero_in = F.max((F.col("chunk_id") == 0).cast("int")).over(per_query) == 1
    size = F.count(F.lit(1)).over(per_query)
    last = ~zero_in & (F.col("rank") == size)
    return top.withColumn("_last", last).select(
        "query_id",
        "doc_id",
        F.when(F.col("_last"), F.lit(0)).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("_last"), F.lit(0)).otherwise(F.col("score")).cast("bigint").alias("score"),
    )


def attach_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranked.join(chunks.select("doc_id", "chunk_id", "text", "pages"), ["doc_id", "chunk_id"])


def pack_context(
    ranked: DataFrame, max_chars: int = KEYWORD_CONTEXT_CHARS, partial: bool = False, order: str = "chunk_id"
) -> DataFrame:
    """(query_id, context): retrieved chunks in order under a character budget.

    Stops at the first chunk over the budget. With `partial` that chunk gives a cut piece when enough room is left.
    """
    w = Window.partitionBy("query_id").orderBy(order)
    used = F.coalesce(
        F.sum(F.length("text") + len(CONTEXT_SEPARATOR)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = ranked.withColumn("_used", used).withColumn("_over", F.col("_used") + F.length("text") > max_chars)
    overflow = F.sum(F.col("_over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_stop", overflow).filter(F.col("_stop") <= 1)
    room = F.lit(max_chars) - F.col("_used") - PARTIAL_MARGIN
    if partial:
        cut = F.when(room > PARTIAL_MIN_CHARS, F.concat(clip(F.col("text"), room.cast("int")), F.lit("...")))
    else:
        cut = F.lit(None).cast("string")
    piece = F.when(F.col("_over"), cut).when(F.col("_stop") == 0, F.col("text"))
    block = F.when(piece.isNotNull(), F.concat(piece, F.lit(CONTEXT_SEPARATOR)))
    return (
        placed.withColumn("_block", block)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct(order, "_block"))).alias("b"))
        .select("query_id", trim_ws(F.array_join(F.col("b._block"), "")).alias("context"))
    )


def chunks_or_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_id, text); a document without any has its filled pages (doc_id, page, text) as chunks."""
    text = trim_ws(F.col("text"))
    filled = pages.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.length(text) > 0)
    numbered = number_rows(filled, ["doc_id"], ["page"], block_of("page"), "chunk_id", 0)
    headed = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), text)
    return chunks.select("doc_id", "chunk_id", "text").unionByName(numbered.select("doc_id", "chunk_id", headed.alias("text")))


def sample_context(
    chunks: DataFrame,
    topics: DataFrame | None = None,
    budget: int = KEYWORD_CONTEXT_CHARS,
    sampled: bool = False,
    samples: int = 6,
    max_topic_chunks: int = 8,
) -> DataFrame:
    """(doc_id, context) for question writing; every document of `chunks` has a row, empty if nothing fits.

    By default the document-order prefix under the budget. `sampled` spends the budget by priority instead: chunks that
    mention a topic of `topics` (doc_id, topic), the first chunk, evenly spaced ones, the last, then the rest; the
    chosen chunks are still joined in document order. Chunk ids may have gaps.
    """
    body = chunks.select("doc_id", "chunk_id", trim_ws(F.col("text")).alias("text"))
    cost = F.length("text") + len(PAGE_JOINER)
    filled = F.length("text") > 0
    if not sampled:
        # a prefix sum over blocks: no document is sorted in one task
        spent = prefix_sums(body.filter(filled), ["doc_id"], ["chunk_id"], {"_before": cost}, block_of("chunk_id"))
    else:
        placed = prefix_sums(
            body, ["doc_id"], ["chunk_id"], {"_place": F.lit(1), "_filled": F.coalesce(filled, F.lit(False)).cast("int")}, block_of("chunk_id")
        )
        counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last"))
        body = block_join(placed, counts, ["doc_id"], "chunk_id", "last").filter(filled)
        if topics is not None:
            lowered = topics.select("doc_id", F.lower("topic").alias("topic")).filter(F.length("topic") > 2)
            needles = lowered.groupBy("doc_id").agg(F.collect_set("topic").alias("topics"))
            body = spread_join(body, needles, ["doc_id"], F.col("chunk_id"), "left")
            on_topic = F.coalesce(F.exists("topics", lambda t: F.contains(F.lower("text"), t)), F.lit(False))
        else:
            on_topic = F.lit(False)
        body = body.withColumn("_topic", on_topic)
        hit_rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))
        hits = body.filter("_topic").select("doc_id", "chunk_id").withColumn("_h", hit_rank).filter(F.col("_h") <= max_topic_chunks)
        m = F.least(F.lit(samples), F.col("n"))
        spaced = F.exists(
            F.sequence(F.lit(0), F.lit(samples)),
            lambda s: (s > 0) & (s < m - 1) & (F.col("_place") == F.floor(s * F.col("n") / m)),
        )
        tier = (
            F.when(F.col("_h").isNotNull(), 0)
            .when(F.col("_place") == 0, 1)
            .when(spaced, 2)
            .when(F.col("_place") == F.col("n") - 1, 3)
            .otherwise(4)
        )
        body = body.join(hits, ["doc_id", "chunk_id"], "left").withColumn("_tier", tier)
        # a filled chunk costs at least 3, so a later one of the last tier than these can't fit
        body = body.filter((F.col("_tier") < 4) | (F.col("_filled") <= budget // (len(PAGE_JOINER) + 1) + max_topic_chunks + samples + 2))
        before = Window.partitionBy("doc_id").orderBy("_tier", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
        spent = body.withColumn("_before", F.coalesce(F.sum(cost).over(before), F.lit(0)))
    # the first block carries no joiner but is charged for one, like every other block
    charged = F.col("_before") + F.when(F.col("_before") == 0, cost).otherwise(F.length("text"))
    packed = (
        spent.filter(charged <= budget)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))
        .select("doc_id", F.array_join(F.col("c.text"), PAGE_JOINER).alias("context"))
    )
    return chunks.select("doc_id").distinct().join(packed, "doc_id", "left").fillna("", ["context"])


def history_window(turns: DataFrame, n: int | None = HISTORY_MESSAGES) -> DataFrame:
    """(conv_id, turn, role, content): the last n messages, then without the empty ones."""
    if n is not None:
        rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
        turns = turns.withColumn("_r", rank).filter(F.col("_r") <= n)
    filled = (F.coalesce(F.col("role"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "")
    return turns.filter(filled).select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"),
        F.col("text").alias("content"),
    )


def build_prompts(queries: DataFrame, contexts: DataFrame, history: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, messages): system, history and the question with its context, one row per query.

    `queries` has (query_id, doc_id, conv_id, question); `meta` has (doc_id, filename, file_type, total_pages,
    has_scanned_content). The history per conversation is at most a window of messages.
    """
    past = history.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("past")
    )
    unit = F.when(F.col("file_type") == "epub", "chapter").otherwise("page")
    system = F.concat(
        F.lit("Answer questions about this "),
        nonempty(F.col("file_type"), F.lit("document")),
        F.lit(" from the given sections only and cite each "),
        unit,
        F.lit(" as ("),
        F.initcap(unit),
        F.lit(' N). Document: "'),
        nonempty(F.col("filename"), F.lit("Untitled")),
        F.lit('", '),
        F.coalesce(F.col("total_pages").cast("string"), F.lit("?")),
        F.lit(" "),
        unit,
        F.lit("s"),
        F.when(F.col("has_scanned_content"), " (some pages were OCR-processed)").otherwise(""),
        F.lit("."),
    )
    ask = F.concat(
        F.lit("Relevant document sections:\n---\n"), F.coalesce("context", F.lit("")), F.lit("\n---\n\nQuestion: "), F.col("question")
    )
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    turns = F.transform(
        F.coalesce("past", F.array().cast("array<struct<turn:bigint,role:string,content:string>>")),
        lambda m: message(m["role"], m["content"]),
    )
    return (
        queries.join(contexts, "query_id", "left")
        .join(past, "conv_id", "left")
        .join(meta, "doc_id", "left")
        .select(
            "query_id",
            F.concat(F.array(message(F.lit("system"), system)), turns, F.array(message(F.lit("user"), ask))).alias("messages"),
        )
    )


def retrieval_report(ranked: DataFrame) -> DataFrame:
    """(query_id, retrieved): chunk id, pages, score and a short preview of every retrieved chunk, in chunk order."""
    row = F.struct("chunk_id", "pages", "score", clip(F.col("text"), PREVIEW_CHARS).alias("preview"))
    return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("retrieved"))

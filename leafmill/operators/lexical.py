"""Terms, vocabularies and TF-IDF vectors of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.blocks import hot_keys, spread_join
from leafmill.functions.text import let, place_of, tokens_of

# Fixed values.
VECTOR_DIM = 256
MAX_DF_RATIO = 0.9
#: chunks of a document that are compared with each other to find one
DOC_CHUNKS = 4096
#: words asked of a document that are looked up together
ASKED = 256


def chunk_terms(chunks: DataFrame, group: str = "doc_id", asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, term, tf, first_pos, n_tokens): term counts per chunk, one map-side combined aggregate.

    Text is several times smaller than its terms, so chunks are shuffled by document, as text, and cut behind that; what
    is grouped by document later then needs no shuffle. With a document too large for one task the terms are shuffled.
    With `asked` (doc_id, term) no other term of a document is counted, as in `posting_blocks`: the text is shuffled once
    and the rest of its tokens never is. The words asked of a document travel in lists of about `ASKED`.
    """
    if asked is None:
        dealt = chunks.select(group, "chunk_id", "text")
        dealt = dealt if hot_keys(chunks, [group]) else dealt.repartition(group)
        cut = dealt.select(group, "chunk_id", tokens_of(F.col("text")).alias("tokens")).select(
            group, "chunk_id", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("pos", "term")
        )
    else:
        words = asked.select(group, "term").distinct()
        shares = words.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("shares"))
        share = F.pmod(F.xxhash64("term"), F.col("shares")).alias("share")
        wanted = words.join(shares, group).groupBy(group, share).agg(F.collect_list("term").alias("asked")).drop("share")
        rows = spread_join(chunks.select(group, "chunk_id", "text"), wanted, [group], F.col("chunk_id"))
        placed = F.transform("tokens", lambda t, at: F.struct(at.alias("pos"), t.alias("term")))
        cut = rows.select(group, "chunk_id", "asked", tokens_of(F.col("text")).alias("tokens")).select(
            group, "chunk_id", F.size("tokens").alias("n_tokens"), F.filter(placed, lambda t: F.array_contains("asked", t["term"])).alias("hits")
        )
        # the outer form, as Spark computes the lists of the other one twice
        cut = cut.select(group, "chunk_id", "n_tokens", F.inline_outer("hits")).filter(F.col("term").isNotNull())
    return (
        cut.groupBy(group, "chunk_id", "term")
        .agg(
            F.count(F.lit(1)).alias("tf"),
            F.min("pos").alias("first_pos"),
            F.first("n_tokens").alias("n_tokens"),
        )
    )


def vocab_topn(
    terms: DataFrame, chunks: DataFrame, dim: int = VECTOR_DIM, max_df: float = MAX_DF_RATIO, group: str = "doc_id"
) -> DataFrame:
    """(doc_id, term, df, n_texts, idx): the most frequent terms of each text set.

    Terms in more than `max_df` of the texts are dropped; ties go to the term seen first. The large sets are told by their
    chunks, which are counted without cutting them into terms. `row_number <= dim` is
    pushed below the shuffle by Spark's group limit, so a large document does not sort all its terms in one task.
    """
    sizes = chunks.groupBy(group).agg(F.count(F.lit(1)).alias("n_texts"))
    whole = terms.schema["chunk_id"].dataType == T.IntegerType()
    at = place_of(F.col("chunk_id"), F.col("first_pos")) if whole else F.struct("chunk_id", "first_pos")
    seen = terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.min(at).alias("seen"))
    by_rank = Window.partitionBy(group).orderBy(F.desc("df"), "seen")
    return (
        spread_join(seen, sizes, [group], F.col("term"), weigh=chunks)
        .filter(F.col("df") <= F.col("n_texts") * F.lit(max_df))
        .withColumn("rank", F.row_number().over(by_rank))
        .filter(F.col("rank") <= dim)
        .select(group, "term", "df", "n_texts", (F.col("rank") - 1).alias("idx"))
    )


def with_vocabulary(terms: DataFrame, vocab: DataFrame, group: str, weigh: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Terms with the columns of their place in the vocabulary.

    `weigh` are the chunks that `terms` come from. If they show no document too large for one task, a document's terms meet
    its whole vocabulary, of bounded size: terms that `chunk_terms` left by document then stay where they are. The term is
    compared as a range, as Spark would shuffle terms and vocabulary by all columns that are compared as equal.
    """
    if weigh is None or hot_keys(weigh, [group]):
        return spread_join(terms, vocab, [group, "term"], F.col("chunk_id"), how)
    known = vocab.select(F.col(group).alias("_group"), F.col("term").alias("_term"), *[c for c in vocab.columns if c not in (group, "term")])
    same = (F.col(group) == F.col("_group")) & (F.col("term") <= F.col("_term")) & (F.col("term") >= F.col("_term"))
    found = terms.join(known.hint("merge"), same, how)
    return found if how == "left_semi" else found.drop("_group", "_term")


def tfidf_weights(terms: DataFrame, vocab: DataFrame, group: str = "doc_id", weigh: DataFrame | None = None) -> DataFrame:
    """Sparse vectors (doc_id, chunk_id, idx, term, weight), scaled to unit length. `weigh` as in `with_vocabulary`."""
    weight = F.col("tf") / F.col("n_tokens") * F.log(F.col("n_texts") / F.col("df"))
    per_chunk = Window.partitionBy(group, "chunk_id")
    raw = with_vocabulary(terms, vocab, group, weigh).select(group, "chunk_id", "idx", "term", weight.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_chunk))
    return raw.withColumn("norm", norm).select(
        group, "chunk_id", "idx", "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight")
    )


def dense_vector(cells: Column, dim: int = VECTOR_DIM) -> Column:
    """Array of `dim` doubles from an array of (idx, weight) cells."""
    slots = F.sequence(F.lit(0), F.lit(dim - 1))
    return let(F.map_from_entries(cells), lambda m: F.transform(slots, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))))


def tfidf_vectors(
    chunks: DataFrame, dim: int = VECTOR_DIM, max_df: float = MAX_DF_RATIO, terms: DataFrame | None = None, vocab: DataFrame | None = None
) -> DataFrame:
    """Chunks with a dense `embedding`; a chunk without vocabulary terms gets the zero vector.

    Terms and vocabulary already at hand can be passed in; otherwise both steps cut the text that was shuffled once.
    """
    terms = chunk_terms(chunks) if terms is None else terms
    vocab = vocab_topn(terms, chunks, dim, max_df) if vocab is None else vocab
    weights = tfidf_weights(terms, vocab, weigh=chunks)
    cells = weights.groupBy("doc_id", "chunk_id").agg(F.collect_list(F.struct("idx", "weight")).alias("cells"))
    empty = F.array().cast("array<struct<idx:int,weight:double>>")
    return (
        _with_cells(chunks, cells)
        .withColumn("embedding", dense_vector(F.coalesce("cells", empty), dim))
        .drop("cells")
    )


def _with_cells(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """Chunks with their cells, or null. Both lie by document already if every document is small, and stay there; its
    chunks are all compared then, with a range as in `with_vocabulary`."""
    several = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DOC_CHUNKS)
    if not several.isEmpty():
        return chunks.join(cells, ["doc_id", "chunk_id"], "left")
    found = cells.select(F.col("doc_id").alias("_doc"), F.col("chunk_id").alias("_chunk"), "cells")
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("chunk_id") <= F.col("_chunk")) & (F.col("chunk_id") >= F.col("_chunk"))
    return chunks.repartition("doc_id").join(found.hint("merge"), same, "left").drop("_doc", "_chunk")


def embedding_source(chunks: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Take every document's vectors from the first source that covers all of its chunks.

    `sources` are (provider, DataFrame(doc_id, chunk_id, embedding)) in order of precedence. Documents covered by none
    keep an empty vector and provider 'none'. Coverage is counted per document before any vector moves.
    """
    wanted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("wanted"))
    ids = chunks.select("doc_id", "chunk_id")
    tagged = None
    for rank, (provider, vectors) in enumerate(sources):
        part = vectors.select("doc_id", "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
        part = part.join(ids, ["doc_id", "chunk_id"], "left_semi").select(
            "*", F.lit(rank).alias("rank"), F.lit(provider).alias("provider")
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    chosen = (
        tagged.groupBy("doc_id", "rank")
        .agg(F.count(F.lit(1)).alias("have"))
        .join(wanted, "doc_id")
        .filter(F.col("have") == F.col("wanted"))
        .groupBy("doc_id")
        .agg(F.min("rank").alias("rank"))
    )
    picked = spread_join(tagged, chosen, ["doc_id", "rank"], F.col("chunk_id"), "left_semi").drop("rank")
    return chunks.join(picked, ["doc_id", "chunk_id"], "left").select(
        *chunks.columns,
        F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"),
        F.coalesce("provider", F.lit("none")).alias("provider"),
    )


def query_vectors(queries: DataFrame, vocab: DataFrame, dim: int = VECTOR_DIM, query_vocab: str = "alone") -> DataFrame:
    """Queries with an `embedding` over the vocabulary of their document.

    A question embedded as a text set of its own ('alone') has no vocabulary, because each term is in all of its one
    text; its vector is zero and hybrid search falls back to keywords. 'corpus' projects it on the document's terms.
    """
    zero = F.array_repeat(F.lit(0.0), dim)
    if query_vocab == "alone":
        return queries.withColumn("embedding", zero)
    asked = queries.select("query_id", "doc_id", F.lit(0).alias("chunk_id"), F.col("question").alias("text"))
    words = chunk_terms(asked, "query_id").join(queries.select("query_id", "doc_id"), "query_id")
    weight = F.col("tf") / F.col("n_tokens") * F.log(F.col("n_texts") / F.col("df"))
    cells = (
        words.join(vocab, ["doc_id", "term"])
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("idx", weight.alias("w"))).alias("cells"))
    )
    length = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["w"] * c["w"]))
    unit = F.transform("cells", lambda c: F.struct(c["idx"], F.when(F.col("_len") > 0, c["w"] / F.col("_len")).otherwise(0.0)))
    dense = cells.withColumn("_len", length).select("query_id", dense_vector(unit, dim).alias("embedding"))
    return queries.join(dense, "query_id", "left").withColumn("embedding", F.coalesce("embedding", zero))

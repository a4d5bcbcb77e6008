"""Tying model output back to its source: snippets to paragraphs, questions to documents, highlights to each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.blocks import number_rows, spread_join
from leafmill.functions.matching import SHINGLE_WORDS, fold, fold_text, fuzzy_contains, shingles, split_words
from leafmill.functions.text import clip, nonempty, trim_ws
from leafmill.operators.cleaning import strip_anchors
from leafmill.session import stage_table

# Fixed values.
MIN_SNIPPET_CHARS = 8
SHINGLE_WEIGHT = 4
MIN_SCORE_SHARE = 0.25
MIN_SCORE_CAP = 20
SNIPPET_LEAD = 20
SNIPPET_EXTRA = 40
SNIPPET_FALLBACK = 200
IMPORTANCES = ("critical", "high", "medium")
DIFFICULTIES = ("easy", "medium", "hard")
QUESTION_TYPES = ("mcq", "true_false", "short")
QUESTION_COUNTS = {"quick": 5, "standard": 10, "deep": 15}
DEFAULT_QUESTIONS = 10
MIN_QUESTIONS, MAX_QUESTIONS = 3, 20
MAX_HIGHLIGHTS = 15
CATEGORY_PROFILES = {
    "invoice": ["amount", "due_date", "vendor", "line_item", "tax", "payment_terms", "financial"],
    "receipt": ["amount", "vendor", "date", "line_item", "tax", "financial"],
    "contract": ["obligation", "party", "term", "clause", "risk", "important_date", "financial"],
    "agreement": ["obligation", "party", "term", "clause", "risk", "important_date"],
    "research_paper": ["finding", "method", "conclusion", "definition", "key_finding"],
    "report": ["key_finding", "conclusion", "recommendation", "risk", "financial", "important_date"],
    "financial_statement": ["financial", "amount", "risk", "key_finding", "conclusion"],
    "resume": ["skill", "experience", "achievement", "education", "key_finding"],
    "letter": ["action_required", "important_date", "key_finding", "conclusion"],
    "proposal": ["action_required", "financial", "important_date", "risk", "conclusion"],
    "form": ["field", "instruction", "action_required", "important_date"],
    "manual": ["instruction", "warning", "definition", "risk"],
}
DEFAULT_CATEGORIES = ["key_finding", "action_required", "important_date", "financial", "risk", "definition", "conclusion"]

#: pairs of short snippets and paragraphs that are compared directly in one document
PAIRS_PER_DOC = 1 << 16
#: highlights of a document that are compared by one task
HIGHLIGHTS_PER_DOC = 1 << 15
#: pairs of highlights, or grams of theirs, that are looked at together
PAIRS_AT_ONCE = 1 << 20
#: characters of a gram in the vocabulary's index
GRAM_CHARS = 3


# ---- snippets -------------------------------------------------------------------------------------------------------


def inner_grams(word: Column, n: int) -> Column:
    """Distinct character n-grams of a word; none for a shorter one."""
    last = F.length(word) - n + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(word, k, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def word_part_pairs(needles: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, nid, pid) of needles (doc_id, nid, nw) whose longest word is part of a word of a paragraph.

    A needle may begin and end inside words, so every paragraph that contains it is among the pairs. The longest word is
    looked for in the document's vocabulary, not in its paragraphs: an index of the vocabulary's character trigrams
    (shorter grams where a shorter word asks) is asked for the word's rarest gram, the words found are compared, and lead
    to the paragraphs that hold them. `postings` has (doc_id, pid, w), each word of a paragraph once.
    """
    longest = F.element_at(F.array_sort(F.transform("nw", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    asked = needles.select("doc_id", "nid", longest.alias("probe"))
    probes = asked.select("doc_id", "probe").distinct().withColumn("size", F.least(F.length("probe"), F.lit(GRAM_CHARS)))
    words = postings.select("doc_id", "w").distinct()
    sizes = probes.select("doc_id", "size").distinct()
    cases = [F.when(F.col("size") == n, inner_grams(F.col("w"), n)) for n in range(1, GRAM_CHARS + 1)]
    index = stage_table(words.join(sizes, "doc_id").select("doc_id", "w", F.explode(F.coalesce(*cases)).alias("g")))
    cases = [F.when(F.col("size") == n, inner_grams(F.col("probe"), n)) for n in range(1, GRAM_CHARS + 1)]
    wanted = probes.select("doc_id", "probe", F.explode(F.coalesce(*cases)).alias("g"))
    often = index.groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no word has is the rarest: such a probe finds nothing
    ranked = wanted.join(often, ["doc_id", "g"], "left").groupBy("doc_id", "probe")
    rarest = ranked.agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    found = rarest.join(index, ["doc_id", "g"]).filter(F.contains("w", F.col("probe"))).select("doc_id", "probe", "w")
    return asked.join(found, ["doc_id", "probe"]).join(postings, ["doc_id", "w"]).select("doc_id", "nid", "pid")


def _hashed(grams: Column) -> Column:
    return F.transform(grams, lambda g: F.xxhash64(g))


def _compared(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(doc_id, needle, paragraph_index, score, at, hay_len) of all pairs of a document that score: its needles meet every
    paragraph in one join, so only the needles are copied and no gram is shuffled."""
    words = needles.withColumn("nw", split_words(F.col("needle"))).withColumn("ng", _hashed(shingles(F.col("nw"))))
    asking = words.groupBy("doc_id").agg(F.collect_list(F.struct("needle", "nw", "ng")).alias("asking"))

    def scores(s: Column) -> Column:
        score = (
            F.when(F.contains("hay", s["needle"]), F.length(s["needle"]))
            .when((F.size(s["nw"]) >= 4) & (F.size("hw") >= 4), SHINGLE_WEIGHT * F.size(F.array_intersect(s["ng"], F.col("hg"))))
            .otherwise(F.size(F.filter(s["nw"], lambda w: F.array_contains(F.col("hw"), w))))
        )
        return F.struct(s["needle"].alias("needle"), score.alias("score"), (F.instr(F.col("hay"), s["needle"]) - 1).alias("at"))

    met = hays.join(asking.hint("merge"), "doc_id").select("doc_id", "pid", "hay", "asking")
    met = met.withColumn("hw", split_words(F.col("hay"))).withColumn("hg", _hashed(shingles(F.col("hw"))))
    found = met.select("doc_id", "pid", F.length("hay").alias("hay_len"), F.explode(F.filter(F.transform("asking", scores), lambda x: x["score"] > 0)).alias("x"))
    return found.select("doc_id", "x.needle", F.col("pid").alias("paragraph_index"), "x.score", "x.at", "hay_len")


def _looked_up(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """The same for documents with many pairs: candidates come from indexes of words and of hashed word 4-grams."""
    needles, hays = needles.withColumn("nw", split_words(F.col("needle"))), hays.withColumn("hw", split_words(F.col("hay")))
    pair = ["doc_id", "nid", "pid"]
    n_size, h_size = F.size("nw"), F.size("hw")
    # word 4-grams on both sides
    ng = needles.filter(n_size >= 4).select("doc_id", "nid", F.explode(_hashed(shingles(F.col("nw")))).alias("g"))
    hg = hays.filter(h_size >= 4).select("doc_id", "pid", F.explode(_hashed(shingles(F.col("hw")))).alias("g"))
    by_gram = ng.join(hg, ["doc_id", "g"]).select(*pair)
    # single words when one side is short
    hword = hays.select("doc_id", "pid", h_size.alias("hn"), F.explode(F.array_distinct("hw")).alias("w"))
    nword = needles.select("doc_id", "nid", n_size.alias("nn"), F.explode(F.array_distinct("nw")).alias("w"))
    by_word = nword.filter("nn < 4").join(hword, ["doc_id", "w"]).select(*pair)
    by_short_hay = nword.filter("nn >= 4").join(hword.filter("hn < 4"), ["doc_id", "w"]).select(*pair)
    # contained snippets of three to five words, by their longest inner word
    inner = F.slice(F.col("nw"), F.lit(2), n_size - 2)
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    by_inner = (
        needles.filter((n_size >= 3) & (n_size <= 5))
        .select("doc_id", "nid", "needle", longest.alias("w"))
        .join(hays.select("doc_id", "pid", "hay", F.explode(F.array_distinct("hw")).alias("w")), ["doc_id", "w"])
        .filter(F.contains("hay", F.col("needle")))
        .select(*pair)
    )
    # one or two words: parts of the vocabulary's words
    by_part = word_part_pairs(needles.filter(n_size <= 2), hword.select("doc_id", "pid", "w"))
    candidates = by_gram.unionByName(by_word).unionByName(by_short_hay).unionByName(by_inner).unionByName(by_part).distinct()
    score = (
        F.when(F.contains("hay", F.col("needle")), F.length("needle"))
        .when(
            (n_size >= 4) & (h_size >= 4),
            SHINGLE_WEIGHT * F.size(F.array_intersect(shingles(F.col("nw")), shingles(F.col("hw")))),
        )
        .otherwise(F.size(F.filter("nw", lambda w: F.array_contains(F.col("hw"), w))))
    )
    return (
        candidates.join(needles, ["doc_id", "nid"])
        .join(hays, ["doc_id", "pid"])
        .select("doc_id", "needle", F.col("pid").alias("paragraph_index"), score.alias("score"),
                (F.instr("hay", F.col("needle")) - 1).alias("at"), F.length("hay").alias("hay_len"))
    )


def locate_snippets(snippets: DataFrame, paragraphs: DataFrame, pairs_per_doc: int = PAIRS_PER_DOC) -> DataFrame:
    """(doc_id, snippet_id, page, section, paragraph_index, snippet, score): best paragraph of every snippet found.

    Equal paragraphs of a document are one candidate (the earliest). Where a document has at most `pairs_per_doc` pairs of
    snippets and paragraphs, all are compared. Where it has more, candidates come from indexes: a snippet that scores at
    all shares a word 4-gram with the paragraph, or a word when one side has fewer than four words. A contained snippet may
    begin and end inside words, so one of at least six words shares an inner 4-gram, one of three to five shares its
    longest inner word, and shorter ones are asked by the character trigrams of the vocabulary. Both ways find the same.
    """
    long_enough = snippets.filter(F.length("snippet") >= MIN_SNIPPET_CHARS)
    asked = long_enough.select("doc_id", "snippet_id", fold(F.col("snippet")).alias("needle")).filter(F.length("needle") > 0)
    # read by both ways and for the counts: written once, not folded again
    needles = stage_table(asked.groupBy("doc_id", "needle").agg(F.min("snippet_id").alias("nid")))
    folded = paragraphs.select("doc_id", "paragraph_index", fold(F.col("text")).alias("hay")).filter(F.length("hay") > 0)
    hays = stage_table(folded.groupBy("doc_id", "hay").agg(F.min("paragraph_index").alias("pid")))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    sides = count(needles, "a").join(count(hays, "b"), "doc_id")
    large = stage_table(sides.filter(F.col("a") * F.col("b") > pairs_per_doc).select("doc_id"))
    compared = _compared(needles.join(large, "doc_id", "left_anti"), hays)
    many = needles.join(large, "doc_id", "left_semi"), hays.join(large, "doc_id", "left_semi")
    scored = compared if large.isEmpty() else compared.unionByName(_looked_up(*many))
    best = scored.groupBy("doc_id", "needle").agg(
        F.max_by(F.struct("paragraph_index", "score", "at", "hay_len"), F.struct("score", -F.col("paragraph_index"))).alias("b")
    ).select("doc_id", "needle", "b.*")
    enough = F.col("score") >= F.least(F.length("needle") * MIN_SCORE_SHARE, F.lit(MIN_SCORE_CAP))
    found = asked.join(best.filter(enough), ["doc_id", "needle"]).drop("needle")

    raw = F.col("text")
    start = F.greatest(F.lit(0), F.floor(F.col("at") / F.col("hay_len") * F.length(raw)).cast("int") - SNIPPET_LEAD)
    window = F.substring(raw, start + 1, F.col("wanted") + SNIPPET_EXTRA)
    return (
        found.join(long_enough.select("doc_id", "snippet_id", F.length("snippet").alias("wanted")), ["doc_id", "snippet_id"])
        .join(paragraphs.select("doc_id", "paragraph_index", "page", "section", "text"), ["doc_id", "paragraph_index"])
        .select(
            "doc_id", "snippet_id", "page", "section", "paragraph_index",
            trim_ws(F.when(F.col("at") < 0, clip(raw, SNIPPET_FALLBACK)).otherwise(window)).alias("snippet"),
            "score",
        )
    )


def enrich_highlights(highlights: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Highlights with `source_reference`: kept where it has a page, else filled from the located paragraph."""
    ref = F.col("source_reference")
    text = nonempty(F.col("text"), ref["snippet"])
    open_rows = highlights.filter(ref["page"].isNull()).select("doc_id", F.col("hl_id").alias("snippet_id"), text.alias("snippet"))
    found = locate_snippets(open_rows, paragraphs).select(
        "doc_id",
        F.col("snippet_id").alias("hl_id"),
        F.struct("page", "section", "paragraph_index", "snippet").alias("_found"),
    )
    return (
        highlights.join(found, ["doc_id", "hl_id"], "left")
        .withColumn("source_reference", F.coalesce("_found", ref))
        .drop("_found")
        .select(*highlights.columns)
    )


def page_density(highlights: DataFrame) -> DataFrame:
    """(doc_id, page, count): highlights per page, fullest page first."""
    page = F.col("source_reference.page")
    return (
        highlights.filter(page.isNotNull())
        .groupBy("doc_id", page.alias("page"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("doc_id", F.desc("count"), "page")
    )


# ---- highlights -----------------------------------------------------------------------------------------------------


def clamp_confidence(c: Column) -> Column:
    """0..100 rounded half up; text that is no number gives 75, while null and the empty string count as 0."""
    numeric = F.rlike(c, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"))
    n = F.when(c.isNull() | (trim_ws(c) == ""), F.lit(0.0)).when(numeric, trim_ws(c).try_cast("double"))
    return F.when(n.isNull() | n.isin(float("inf"), float("-inf")), 75).otherwise(F.floor(F.least(F.greatest(n, F.lit(0.0)), F.lit(100.0)) + 0.5)).cast("int")


def normalise_highlights(highlights: DataFrame, doc_types: DataFrame) -> DataFrame:
    """Defaults and ranges put right; `off_profile` flags categories unusual for the document's type, unchanged."""
    profiles = F.create_map(
        *[x for k, v in CATEGORY_PROFILES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]
    )
    default = F.array(*[F.lit(c) for c in DEFAULT_CATEGORIES])
    typed = highlights.join(doc_types.select("doc_id", "document_type"), "doc_id", "left")
    allowed = F.coalesce(F.try_element_at(profiles, F.coalesce("document_type", F.lit("other"))), default)
    return (
        typed.withColumn("text", trim_ws(F.coalesce("text", F.lit(""))))
        .withColumn("importance", F.when(F.col("importance").isin(*IMPORTANCES), F.col("importance")).otherwise("medium"))
        .withColumn("category", nonempty(F.col("category"), F.lit("key_finding")))
        .withColumn("reason", trim_ws(F.coalesce("reason", F.lit(""))))
        .withColumn("confidence", clamp_confidence(F.col("confidence")))
        .withColumn("off_profile", ~F.array_contains(allowed, F.col("category")))
    )


def merge_highlights(highlights: DataFrame, max_n: int | None = None, min_overlap: float = 0.8, per_doc: int = HIGHLIGHTS_PER_DOC) -> DataFrame:
    """Highlights left after duplicates and near-duplicates give way to a better ranked one.

    All of them, or the first `max_n` (suggested: MAX_HIGHLIGHTS) per document.

    Near-duplicates share at least `min_overlap` of the smaller one's word 4-grams. Exact copies go first. Pairs are then
    found by prefix filtering: of a set's grams, rarest first, the leading |A| - ceil(min_overlap |A|) + 1 must hit
    the other set, so frequent grams never meet each other. Highlights of one document only meet each other, so a document
    of at most `per_doc` is shuffled once, as text, and compared by one task; the grams of larger ones are joined.
    """
    weight = F.when(F.col("importance") == "critical", 0).when(F.col("importance") == "high", 1).otherwise(2)
    rank = F.struct(weight.alias("w"), (-F.col("confidence")).alias("c"), F.col("hl_id").alias("hl_id"))
    known = highlights.filter(F.col("doc_id").isNotNull())
    large = stage_table(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_doc).select("doc_id"))
    if large.isEmpty():
        small, rest = known, known.limit(0)
    else:
        small, rest = known.join(large, "doc_id", "left_anti"), known.join(large, "doc_id", "left_semi")
    placed = _merged_together(small, rank, min_overlap).unionByName(_merged_by_index(rest, rank, min_overlap))
    return placed if max_n is None else placed.filter(F.col("position") <= max_n)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to about `most`, one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of every k, sizes[k] of them."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many word n-grams every text has, and the number of each gram, equal for equal ones."""
    known: dict[str, int] = {}
    rows = [[known.setdefault(w, len(known)) for w in t.split(" ") if w] for t in texts]
    words = np.array([w for r in rows for w in r], np.int64)
    sizes = np.array([max(len(r) - SHINGLE_WORDS + 1, 0) for r in rows], np.int64)
    starts = np.cumsum([0, *map(len, rows)])[:-1]
    at = _spread(starts, sizes)
    gram = words[at]
    for k in range(1, SHINGLE_WORDS):
        gram = np.unique(gram * max(len(known), 1) + words[at + k], return_inverse=True)[1]
    return sizes, gram


def _beaten(own: np.ndarray, gram: np.ndarray, first: np.ndarray, min_overlap: float) -> np.ndarray:
    """Which sets overlap with one that ranks before them. `own` and `gram` are the distinct pairs of set and gram, by
    set, both numbered from 0; `first` is the rank of every set."""
    n, df = np.bincount(own, minlength=len(first)), np.bincount(gram)
    start, head = np.cumsum(n) - n, np.cumsum(df) - df
    rarest = np.lexsort((gram, df[gram], own))
    x, g = own[rarest], gram[rarest]
    leading = np.arange(len(x)) - start[x] + 1 <= n[x] - np.ceil(n[x] * min_overlap) + 1
    x, g = x[leading & (df[g] > 1)], g[leading & (df[g] > 1)]
    holders = own[np.argsort(gram, kind="stable")]
    cells = own * len(df) + gram
    lost = np.zeros(len(first), bool)
    for a, b in _slices(df[g], PAIRS_AT_ONCE):
        p, q = np.repeat(x[a:b], df[g[a:b]]), holders[_spread(head[g[a:b]], df[g[a:b]])]
        pair = np.unique((np.minimum(p, q) * len(first) + np.maximum(p, q))[p != q])
        p, q = pair // len(first), pair % len(first)
        less, more = np.where(n[p] <= n[q], p, q), np.where(n[p] <= n[q], q, p)
        for c, d in _slices(n[less], PAIRS_AT_ONCE):
            size = n[less[c:d]]
            asked = np.repeat(more[c:d], size) * len(df) + gram[_spread(start[less[c:d]], size)]
            hit = cells[np.minimum(np.searchsorted(cells, asked), len(cells) - 1)] == asked
            both = np.bincount(np.repeat(np.arange(d - c), size), hit, d - c)
            near = both >= size * min_overlap
            lost[np.where(first[p[c:d]] < first[q[c:d]], q[c:d], p[c:d])[near]] = True
    return lost


def _merged_together(highlights: DataFrame, rank: Column, min_overlap: float) -> DataFrame:
    """Highlights left, with their `position`, where a document is small enough for one task."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("_rank"))
    ranked = highlights.withColumn("_rank", rank).withColumn("_order", order).drop("_rank")
    schema, columns = T.StructType([*highlights.schema.fields, T.StructField("position", T.IntegerType())]), highlights.columns

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        """A number for every distinct value, -1 for null."""
        return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def merge(doc: pa.Table) -> pa.Table:
        doc = doc.sort_by("_order")
        ids = numbers(doc["hl_id"])
        norms = np.array([fold_text(t) for t in doc["text"].to_pylist()], dtype=object)
        lead = np.sort(np.unique(numbers(pa.chunked_array([pa.array(norms, pa.string())])), return_index=True)[1])
        lead = lead[ids[lead] >= 0]
        sizes, gram = _word_grams(norms[lead].tolist())
        inked, own = np.unique(np.repeat(ids[lead], sizes), return_inverse=True)
        gone = inked[:0]
        if len(own):
            cells = np.unique(own * (gram.max() + 1) + gram)
            first = np.full(ids.max() + 1, doc.num_rows)
            np.minimum.at(first, ids[lead], lead)
            gone = inked[_beaten(cells // (gram.max() + 1), cells % (gram.max() + 1), first[inked], min_overlap)]
        kept = doc.filter(pa.array(np.isin(ids, ids[lead]) & ~np.isin(ids, gone))).select(columns)
        return kept.append_column("position", pa.array(np.arange(1, kept.num_rows + 1), pa.int32()))

    return ranked.groupBy("doc_id").applyInArrow(merge, schema)


def _merged_by_index(highlights: DataFrame, rank: Column, min_overlap: float) -> DataFrame:
    """As `_merged_together`, for documents of any size: grams meet in joins."""
    ranked = stage_table(highlights.withColumn("_rank", rank).withColumn("_norm", fold(F.col("text"))))
    lead = ranked.groupBy("doc_id", "_norm").agg(F.min("_rank").alias("_rank"))
    # a gram travels as the hash of its document and itself, so every step moves numbers, not texts
    grams = F.transform(shingles(split_words(F.col("_norm"))), lambda g: F.xxhash64("doc_id", g))
    bags = stage_table(
        lead.select("doc_id", F.col("_rank.hl_id").alias("hl_id"), "_rank", grams.alias("gs"))
        .filter(F.col("hl_id").isNotNull() & (F.size("gs") > 0))
        .groupBy("doc_id", "hl_id").agg(F.min("_rank").alias("_rank"), F.array_distinct(F.flatten(F.collect_list("gs"))).alias("gs"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    sets = bags.select("nid", F.size("gs").alias("n"), F.explode("gs").alias("g"))
    # grams that one highlight alone has are the rarest and meet nothing, so they are only counted
    shared = stage_table(sets.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("g"))).filter("df > 1"))
    per_hl = Window.partitionBy("nid")
    alone = F.col("n") - F.count(F.lit(1)).over(per_hl)
    placed = shared.withColumn("pos", alone + F.row_number().over(per_hl.orderBy("df", "g")))
    prefix = placed.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * F.lit(min_overlap)) + 1)
    pairs = prefix.select("g", F.col("nid").alias("x")).join(shared.select("g", F.col("nid").alias("y")), "g").filter("x <> y")
    candidates = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda s: bags.select(F.col("nid").alias(s), "doc_id", F.col("hl_id").alias(f"h{s}"), F.col("gs").alias(f"g{s}"), F.col("_rank").alias(f"r{s}"))
    overlap = F.size(F.array_intersect("ga", "gb"))
    near = candidates.join(side("a"), "a").join(side("b").drop("doc_id"), "b").filter(
        overlap >= F.least(F.size("ga"), F.size("gb")) * F.lit(min_overlap)
    )
    beaten = near.select("doc_id", F.when(F.col("ra") < F.col("rb"), F.col("hb")).otherwise(F.col("ha")).alias("hl_id")).distinct()
    firsts = lead.select("doc_id", F.col("_rank.hl_id").alias("hl_id"))
    kept = ranked.join(firsts, ["doc_id", "hl_id"], "left_semi").join(beaten, ["doc_id", "hl_id"], "left_anti")
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("_rank"))
    return kept.withColumn("position", position).drop("_rank", "_norm")


def highlight_listing(highlights: DataFrame, block: Column | None = None) -> DataFrame:
    """(doc_id, item_no, line): numbered `i. [importance / category] text` lines."""
    line = F.concat(
        F.col("item_no").cast("string"), F.lit(". ["), nonempty(F.col("importance"), F.lit("medium")), F.lit(" / "),
        nonempty(F.col("category"), F.lit("general")), F.lit("] "), F.col("text"),
    )
    blocks = F.floor(F.col("hl_id") / 4096).cast("bigint") if block is None else block
    return number_rows(highlights, ["doc_id"], ["hl_id"], blocks, "item_no").select("doc_id", "item_no", line.alias("line"))


# ---- questions ------------------------------------------------------------------------------------------------------


def requested_questions(length: Column) -> Column:
    counts = F.create_map(*[F.lit(x) for kv in QUESTION_COUNTS.items() for x in kv])
    n = F.coalesce(F.try_element_at(counts, length), F.lit(DEFAULT_QUESTIONS))
    return F.least(F.greatest(n, F.lit(MIN_QUESTIONS)), F.lit(MAX_QUESTIONS))


def check_questions(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Questions with their final `type` and the `reason` they are dropped for (null when kept).

    The document text is folded once per document, then joined.
    """
    text = lambda c: trim_ws(F.coalesce(c, F.lit("")))
    hays = docs.select("doc_id", fold(strip_anchors(F.coalesce("text", F.lit("")))).alias("_hay"))
    asked = (
        questions.withColumn("question", text("question"))
        .withColumn("answer", text("answer"))
        .withColumn("source_text", text("source_text"))
        .withColumn("_src", fold(F.col("source_text")))
        .withColumn("_ans", fold(F.col("answer")))
    )
    q = spread_join(asked, hays, ["doc_id"], F.col("pos"), "left", weigh=questions)
    options = F.col("options")
    kind = F.when(F.col("type").isin(*QUESTION_TYPES), F.col("type")).when(F.size(options) >= 3, "mcq").otherwise("short")
    blank = (F.col("question") == "") | (F.col("answer") == "") | (F.col("source_text") == "")
    hay = F.coalesce("_hay", F.lit(""))
    supported = fuzzy_contains(F.col("_src"), F.col("_ans")) | fuzzy_contains(hay, F.col("_ans"))
    mcq, tf = kind == "mcq", kind == "true_false"
    reason = (
        F.when(blank, "missing required fields")
        .when(~fuzzy_contains(hay, F.col("_src")), "source_text not in document")
        .when(mcq & (F.coalesce(F.size(options), F.lit(0)) < 2), "mcq missing options")
        .when(mcq & ~F.array_contains(options, F.col("answer")), "answer not among options")
        .when(mcq & ~supported, "mcq answer not in document")
        .when(tf & ~F.col("answer").isin("True", "False", "true", "false"), "invalid true_false answer")
    )
    return q.withColumn("reason", reason).withColumn("type", kind).drop("_src", "_ans", "_hay")


def validate_questions(questions: DataFrame, docs: DataFrame, max_options: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): `questions` has (doc_id, pos, id, type, question, options, answer, …).

    Options are kept whole, or cut to the first `max_options` (suggested: 4), which may cut the right answer out.
    """
    options = F.col("options") if max_options is None else F.slice("options", 1, max_options)
    # counted, joined, numbered and listed again: each is read from a table, so nothing is parsed or checked twice
    checked = stage_table(check_questions(stage_table(questions), docs))
    kept = number_rows(checked.filter(F.col("reason").isNull()), ["doc_id"], ["pos"], F.floor(F.col("pos") / 4096).cast("bigint"), "_n")
    tf = F.col("type") == "true_false"
    final = kept.select(
        "doc_id",
        "pos",
        nonempty(F.col("id"), F.concat(F.lit("q"), F.col("_n").cast("string"))).alias("id"),
        "type",
        "question",
        F.when(F.col("type") == "mcq", options).alias("options"),
        F.when(tf, F.initcap("answer")).otherwise(F.col("answer")).alias("answer"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        "source_text",
        F.when(F.col("difficulty").isin(*DIFFICULTIES), F.col("difficulty")).otherwise("medium").alias("difficulty"),
        nonempty(trim_ws(F.col("topic")), F.lit("General")).alias("topic"),
    )
    dropped = checked.filter(F.col("reason").isNotNull()).select("doc_id", "pos", clip(F.col("question"), 60).alias("question"), "reason")
    return final, dropped


def question_references(kept: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Kept questions with `source_reference`; a question not located refers to the start of its source text."""
    asked = kept.select("doc_id", F.col("pos").alias("snippet_id"), F.col("source_text").alias("snippet"))
    found = locate_snippets(asked, paragraphs).withColumnRenamed("snippet_id", "pos").drop("score")
    joined = kept.join(found, ["doc_id", "pos"], "left")
    ref = F.struct("page", "section", "paragraph_index", nonempty(F.col("snippet"), clip(F.col("source_text"), 80)).alias("snippet"))
    return joined.withColumn("source_reference", ref).select(*kept.columns, "source_reference")


def question_summary(questions: DataFrame, kept: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, requested_count, valid_count, insufficient): `requests` is (doc_id, length)."""
    valid = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("valid_count"))
    return (
        requests.select("doc_id", requested_questions(F.col("length")).alias("requested_count"))
        .join(valid, "doc_id", "left")
        .fillna(0, ["valid_count"])
        .withColumn("insufficient", F.col("valid_count") == 0)
    )

"""Properties that hold for any corpus."""

import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.functions.blocks import NO_ANCHOR, apply_steps, block_anchors, block_of, block_steps, carry_forward, compose_steps, entry_anchors, number_rows, prefix_sums
from leafmill.operators import diffing, grounding, pagesets, pagination
from leafmill.streaming import limits


def corpus(spark):
    rng = np.random.default_rng(11)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(d, " ".join(rng.choice(words, int(n)))) for d, n in enumerate(rng.integers(1, 200, 12))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_reverse_twice_is_identity(spark):
    pages = pagination.paginate_fixed(corpus(spark), 100).select("doc_id", "page", "text")
    assert rows_of(pagesets.reverse_pages(pagesets.reverse_pages(pages)), "doc_id", "page", "text") == rows_of(pages, "doc_id", "page", "text")


def test_dedupe_is_idempotent(spark):
    pages = pagination.paginate_fixed(corpus(spark), 20).select("doc_id", "page", "text")
    once = pagesets.dedupe_pages(pages)
    assert rows_of(pagesets.dedupe_pages(once), "doc_id", "page", "text") == rows_of(once, "doc_id", "page", "text")


def test_diff_with_itself(spark):
    pages = pagination.paginate_fixed(corpus(spark), 100).select("doc_id", "page", "text")
    assert {r["status"] for r in diffing.page_diffs(pages, pages).collect()} == {"identical"}
    assert {r["similarity"] for r in diffing.diff_summary(pages, pages).collect()} == {100.0}


def test_blocked_sums_and_carry_match_plain_windows(spark):
    """One key owns most rows and spans many blocks."""
    rng = np.random.default_rng(3)
    rows = [("hot", i, int(v), str(v) if v % 3 == 0 else None) for i, v in enumerate(rng.integers(0, 50, 500))]
    rows += [(f"k{i % 7}", i, i, None if i % 2 else str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, pos int, v int, s string")
    got = carry_forward(
        number_rows(prefix_sums(df, ["k"], ["pos"], {"before": F.col("v")}, block_of("pos", 16)), ["k"], ["pos"], block_of("pos", 16), "n"),
        ["k"], ["pos"], F.col("s"), block_of("pos", 16), "last",
    )
    want, state = [], {}
    for k, pos, v, s in sorted(rows):
        total, n, last = state.get(k, (0, 0, None))
        want.append((k, pos, total, n + 1, last))
        state[k] = (total + v, n + 1, s if s is not None else last)
    assert sorted((tuple(r) for r in got.select("k", "pos", "before", "n", "last").collect()), key=lambda r: r[:2]) == want


def random_blocks(rng, count, rows):
    """Blocks of one key, coordinates relative to the block, as page packing hands them in."""
    out = []
    for _ in range(count):
        width = rng.integers(1, 40, int(rng.integers(1, rows)))
        end = np.cumsum(width).astype(float)
        out.append((end - width, end, rng.random(len(width)) < 0.1, float(end[-1])))
    return out


def test_composed_steps_are_associative_and_agree_with_replay():
    rng = np.random.default_rng(7)
    for limit in (5.0, 60.0, 900.0):
        for _ in range(60):
            blocks = random_blocks(rng, 5, 9)
            steps = [(*block_steps(a, e, h, limit), span) for a, e, h, span in blocks]
            left = steps[0]
            for s in steps[1:]:
                left = compose_steps(left, s, limit)
            right = steps[-1]
            for s in reversed(steps[:-1]):
                right = compose_steps(s, right, limit)
            for entry in (NO_ANCHOR, *(-rng.integers(0, 950, 12).astype(float))):
                at = entry
                for a, e, h, span in blocks:
                    # a hard row and a row past the limit leave nothing open, or themselves
                    anchors = block_anchors(a, e, h, limit, at)
                    at = (NO_ANCHOR if h[-1] else anchors[-1]) - span
                for whole in (left, right):
                    assert float(apply_steps(*whole[:2], whole[2], limit, np.float64(entry))) == at


def test_entry_anchors_over_rounds_of_many_blocks(spark):
    """A key of 200 blocks with gaps, scanned two blocks at a time, and keys of one, two and negative block numbers."""
    rng = np.random.default_rng(19)
    limit, rows, want = 90.0, [], {}
    for key, numbers in (("hot", np.sort(rng.choice(5000, 200, replace=False))), ("two", [3, 9]), ("one", [0]), ("low", [-70, -1, 0, 80])):
        at = NO_ANCHOR
        for number, (a, e, h, span) in zip(numbers, random_blocks(rng, len(numbers), 12)):
            rows.append((key, int(number), a.tolist(), e.tolist(), h.tolist(), span))
            want[key, int(number)] = at
            anchors = block_anchors(a, e, h, limit, at)
            at = (NO_ANCHOR if h[-1] else anchors[-1]) - span
    df = spark.createDataFrame(rows, "k string, _blk bigint, a array<double>, e array<double>, hard array<boolean>, span double")
    del want["one", 0]
    for bits in (1, 6):
        assert {(r["k"], r["_blk"]): r["entry"] for r in entry_anchors(df, ["k"], limit, bits).collect()} == want
    assert entry_anchors(df.filter("k = 'one'"), ["k"], limit).collect() == []


def test_rate_limit_hot_key(spark):
    """Brute force over a key with bursts, gaps and ties."""
    rng = np.random.default_rng(8)
    ms = np.cumsum(rng.choice([0, 1, 400, 2500, 70_000], 800, p=[0.2, 0.3, 0.3, 0.19, 0.01]))
    rows = [(1, i, int(t)) for i, t in enumerate(ms)] + [(2, 9000 + i, i * 1000) for i in range(31)] + [(2, 9900, 61_000)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ms bigint")
    got = {r["event_id"]: (r["count"], r["allowed"], r["retry_after"]) for r in limits.rate_limit(df, "user_id").collect()}
    want, state = {}, {}
    for u, e, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, n = state.get(u, (t, 0))
        start, n = (t, 0) if t - start > 60_000 else (start, n)
        state[u] = (start, n + 1)
        want[e] = (n + 1, n < 30, None if n < 30 else -(-(start + 60_000 - t) // 1000))
    assert got == want
    assert got[9030] == (31, False, 30) and got[9900][1]


def test_merge_highlights_against_all_pairs(spark):
    """Prefix filtering finds the near-duplicates that comparing all pairs finds."""
    rng = np.random.default_rng(21)
    base = [" ".join(rng.choice(list("abcdefghij"), 12)) for _ in range(15)]
    texts = base + [t + " z" for t in base[:8]] + [" ".join(t.split()[:-1]) for t in base[4:10]] + base[:3]
    rows = [(1, i, t, ["critical", "high", "medium"][i % 3], int(rng.integers(0, 100))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, hl_id int, text string, importance string, confidence int")
    got = [r["hl_id"] for r in grounding.merge_highlights(df, 100).orderBy("position").collect()]
    order = sorted(rows, key=lambda r: (["critical", "high", "medium"].index(r[3]), -r[4], r[1]))
    firsts, seen = [], set()
    for r in order:
        if r[2] not in seen:
            seen.add(r[2])
            firsts.append(r)
    grams = lambda t: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)}
    near = lambda a, b: len(grams(a) & grams(b)) >= 0.8 * min(len(grams(a)), len(grams(b)))
    want = [r[1] for i, r in enumerate(firsts) if not any(near(r[2], b[2]) for b in firsts[:i])]
    assert got == want


def test_merge_highlights_together_and_by_index(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for doc in (1, 2, None, 3):
        texts = [[rng.choice("abcdefg") * 3 for _ in range(rng.randint(0, 9))] for _ in range(12)]
        for k in range(60):
            words = list(rng.choice(texts))
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "new"
            hl_id = None if rng.random() < 0.05 else rng.randrange(50)
            rows.append((doc, hl_id, rng.choice([" ".join(words), " ".join(words).upper(), None]), rng.choice(["critical", "high", None]), rng.choice([50, 90, None])))
    df = spark.createDataFrame(rows, "doc_id int, hl_id int, text string, importance string, confidence int")
    plain = lambda found: sorted((r["doc_id"], r["hl_id"], str(r["text"]), str(r["importance"]), str(r["confidence"])) for r in found.collect())
    monkeypatch.setattr(grounding, "PAIRS_AT_ONCE", 7)
    indexed, mixed = grounding.merge_highlights(df, per_doc=0), grounding.merge_highlights(df, per_doc=59)
    together = grounding.merge_highlights(df)
    assert len(plain(together)) > 20 and plain(together) == plain(indexed) == plain(mixed)
    plan = grounding._merged_together(df, F.struct("confidence", "hl_id"), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    for doc in (1, 2, 3):
        assert [r["position"] for r in together.filter(F.col("doc_id") == doc).orderBy("position").collect()] == list(range(1, together.filter(F.col("doc_id") == doc).count() + 1))


def test_folding_in_python_is_that_of_the_columns(spark):
    from leafmill.functions.matching import fold, fold_text

    texts = ["", " ", "Ünï çode ÉCOLE straße ﬁx İ ſ K", "a\u0301b\tc\u00a0d\u2003e", "x-y/z (q)! «r» \U0001d11e1\u0661_", "…\u0300\u0345 A\u200bB", "\x00\x1c ab\n", "١٢٣ ½ ² №"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in rows] == [fold_text(r["t"]) for r in rows]

"""The Jaccard join against brute force, and the bounds it rests on."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from leafmill.llm import near_dedup, parity_join

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, nid int, key int, node int"


def token_set(text, n=3):
    words = WORDS.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, percent=90):
    """One entry a row: (doc_id, set size, smallest doc_id of its group)."""
    sets = [frozenset(token_set(t)) for _, t in rows]
    nodes = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            nodes.setdefault(s, []).append(i)
    parent = {s: s for s in nodes}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in combinations(nodes, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            parent[root(a)] = root(b)
    least = {}
    for s, ids in nodes.items():
        least[root(s)] = min([*ids, *([least[root(s)]] if root(s) in least else [])])
    return sorted(((i, len(s), None if i is None else least[root(s)] if s else i) for (i, _), s in zip(rows, sets)), key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], DOCS).repartition(4)
    got = parity_join.jaccard_groups(df, **options).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, options.get("percent", 90))


def edited(rng, words, changes):
    words = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        words[at] = f"e{rng.integers(1_000_000)}"
    return " ".join(words)


def family(seed, length, members, most):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(10_000)}" for _ in range(length)]
    return [" ".join(base), *(edited(rng, base, int(rng.integers(0, most + 1))) for _ in range(members)), " ".join(base[: int(length * 0.93)])]


def test_groups_equal_brute_force(spark):
    texts = [t for k, size in enumerate([8, 9, 11, 12, 13, 20, 33, 60, 61, 150, 400]) for t in family(k, size, 6, max(1, size // 25))]
    texts += family(99, 3000, 4, 60) + ["chain " + " ".join(f"c{j}" for j in range(k, k + 40)) for k in range(30)]
    odd = [None, "", " \t\n", "one two", "One  TWO", "a b c", "A b C", "x" * 300_000 + " y z", "same words " * 500, "same words " * 700, "día 漢字 go", "DÍA 漢字 go"]
    rows = [(k, t) for k, t in enumerate([*texts, *odd])]
    rows += [(None, texts[0]), (3, texts[40]), (3, texts[40]), (5, texts[41].upper()), (-7, texts[60]), (1, texts[70])]
    check(spark, rows)
    check(spark, rows[:40], percent=75)
    assert parity_join.jaccard_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_crowded_buckets_are_divided_and_lose_nothing(spark, monkeypatch):
    """Texts that share a long passage meet in the same buckets without being linked; some of them are."""
    monkeypatch.setattr(parity_join, "BLOCK", 7)
    monkeypatch.setattr(parity_join, "COMPARED", 60)
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(90)]
    texts = [" ".join([*passage, *(f"t{rng.integers(1_000_000)}" for _ in range(20))]) for _ in range(60)]
    texts += [edited(rng, t.split(), 1) for t in texts[::4]]
    check(spark, [*enumerate(texts), *((500 + k, t) for k, t in enumerate(family(4, 100, 40, 2)))])


def test_many_texts_under_one_id(spark):
    rows = [(1, t) for t in family(2, 80, 60, 2)] + [(2, t) for t in family(3, 80, 3, 1)] + [(1, "other text entirely " * k) for k in range(1, 5)]
    check(spark, rows)


@pytest.mark.parametrize("percent", [60, 75, 90, 95])
def test_linked_sets_share_a_key_and_differ_in_few_bits(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop, add = rng.integers(0, n // 6 + 2, 2)
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and both < len(a) + len(b) - both:
            assert set(parity_join.set_keys(a, percent).tolist()) & set(parity_join.set_keys(b, percent).tolist())
            assert len(a) + len(b) - 2 * both <= parity_join.most_different(len(a), len(b), percent)
        sketch = parity_join.stacked([parity_join.parity_sketch(s) for s in (a, b)]) if len(b) else np.zeros((2, 1), np.uint64)
        assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= len(a) + len(b) - 2 * both


def test_words_of_patterns_are_told_apart():
    """Patterns that meet in polynomial hashes modulo 2**64."""
    import pyarrow as pa

    a = "".join("ab"[bin(k).count("1") & 1] for k in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    sets = near_dedup.shingle_sets(pa.array([f"{a} x y", f"{b} x y", f"{a} x y"]), 3)
    assert sets[0].tolist() == sets[2].tolist() != sets[1].tolist()


def test_few_pairs_of_a_near_group_are_confirmed(spark, monkeypatch):
    """A group of m near copies has m * m pairs; those given before its members are joined grow with m only."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, edited(rng, base, 2)) for k in range(120)] + [(500, " ".join(f"z{k}" for k in range(400)))]
    confirm, given = parity_join._confirm, []
    monkeypatch.setattr(parity_join, "_confirm", lambda pairs, *rest: (given.append(pairs.count()), confirm(pairs, *rest))[1])
    monkeypatch.setattr(parity_join, "STAR_ROUNDS", 0)
    check(spark, rows)
    assert 0 < sum(given) < 10 * 120


def test_pairs_behind_the_nearest_ones_are_not_left_out(spark, monkeypatch):
    """The nearest partner by sketch may be no link; the others are compared whole in the last round."""
    monkeypatch.setattr(parity_join, "STAR_ROUNDS", 0)
    monkeypatch.setattr(parity_join, "NEAREST", ())
    rows = list(enumerate(family(11, 120, 20, 6)))
    check(spark, rows)
    monkeypatch.setattr(parity_join, "NEAREST", (1,))
    check(spark, rows)

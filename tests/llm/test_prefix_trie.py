"""The conversation trie against brute force, with blocks small enough that prefixes cross several levels of them."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from leafmill.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, rank int, block string, d int, l string, seq int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, below, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        cost = (len(convs) - 1) * len(WORDS.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]] += node not in children
            saved[node[:d]] += cost
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children.get(node, 0), below[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    rows = [(*r, 1, "x", 2, "y", 3) for r in rows]
    got = sorted((tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert got == brute(rows)


def shared_turns(n, seed):
    """Few different turns, so prefixes of all widths and copies are common."""
    rng = np.random.default_rng(seed)
    return [(c, k, f"r{k % 2}", "go " * int(rng.integers(1, 3) if k else 1)) for c in range(n) for k in range(int(rng.integers(1, 9)))]


@pytest.mark.parametrize("n, bits", [(150, 1), (150, 2), (400, 4)])
def test_trie_equals_brute_force_over_many_blocks(spark, monkeypatch, n, bits):
    monkeypatch.setattr(trie, "BLOCK_BITS", bits)
    monkeypatch.setattr(trie, "BLOCK", 1 << bits)
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 3)
    check(spark, shared_turns(n, bits))


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [(0, None, None, None), (0, 2, "a", "b"), (0, 2, "a", "b"), (0, 1, "", ""), (1, 5, "a", "b"), (-3, 1, "a", "b"), (-20, 1, "a", "ab"), (None, 1, "a", "b"), (19, None, "a", "x é"), (25, 1, "user", long), (39, 1, "user", long)]
    rows += [(45, k, "u", f"turn {k // 2}") for k in range(300)] + [(46, k, "u", f"turn {k // 2}") for k in range(299)] + [(c, 1, "same", "text") for c in range(500, 900)]
    check(spark, rows)
    check(spark, [(7, 1, "a", "b")])
    check(spark, [(40 + c, 1, "a", "b") for c in range(1, 20)])  # first turns give way to a conversation that is absent
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_minima_search_both_ways():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 9, 77)
    table, at, d = trie.Minima(v), rng.integers(0, 77, 500), rng.integers(0, 10, 500)
    assert table.first_below(at, d).tolist() == [next((j for j in range(a + 1, 77) if v[j] < x), 77) for a, x in zip(at, d)]
    assert table.last_below(at, d).tolist() == [next((j for j in range(a - 1, -1, -1) if v[j] < x), -1) for a, x in zip(at, d)]
    stop = np.minimum(at + 1 + d, 77)
    assert table.least(at, stop).tolist() == [v[a:b].min() for a, b in zip(at, stop)]

"""The Merkle manifest against a brute-force tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm.merkle import merkle_proofs, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key int, rank int, item string, above string, n long, hash string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and per node the siblings before and after it of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // 16 * 16
            paths[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 16])))
            at[i] = place // 16
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return (nodes or [""])[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names]
    root, tops = climb([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops):
        for (known, doc_id, leaf, row), path in zip(sorted(groups[s], key=lambda g: g[:3]), paths):
            path = path + top
            tampered = known and zlib.crc32(str(doc_id).encode()) % 5 == 0
            text = row[4] if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            folded = leaf_of(row, text) if tampered else leaf
            for before, after in path:
                folded = H(before, folded, after)
            out.append((row[0], leaf, subroot, root, H(*[b + a for b, a in path]), folded, folded == root))
    return sorted(out, key=str)


def proofs(df):
    where = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle_proofs(df, altered={"text": low}, where=where)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest("proof"), "folded_root", "verified")


def rows_of(spec):
    return [(i, s, lang, n, t, 1, 2, "x", "y", 3, "z") for i, s, lang, n, t in spec]


LONG = "Long É " * 40_000
ODD = [(None, None, None, None, None), (None, "", "", 0, ""), (7, None, "de", 1, "A"), (7, None, "de", 1, "A"), (7, "", "de", 2, "Äb"), (-5, "é", "x", -1, LONG), (5, "Z", None, 5, None), (9, "z", "1:", 5, "2:A")]


@pytest.mark.parametrize("spec", [
    ODD, [(3, "one", "en", 1, "Alone")],
    ODD + [(k * 7 % 5003, "hot", "en", k % 3, f"Text {k % 900}") for k in range(4400)] + [(k, f"s{k % 37}", "fr", 1, "X") for k in range(700)] + [(1, "copies", "en", 1, "Same")] * 600,
    [(k, f"s{k}", "en", 1, f"T{k}") for k in range(300)],
], ids=["odd rows", "one row", "several rounds", "groups of one"])
def test_proofs_equal_brute_force(spark, spec):
    got = sorted((tuple(r) for r in proofs(spark.createDataFrame(rows_of(spec), SCHEMA).repartition(5)).collect()), key=str)
    assert got == brute(rows_of(spec))


def test_unaltered_rows_all_verify_and_an_empty_table_is_empty(spark):
    df = spark.createDataFrame(rows_of(ODD * 40), SCHEMA)
    found = merkle_proofs(df).collect()
    assert len(found) == len(ODD) * 40 and all(r["verified"] for r in found)
    assert merkle_proofs(df.where("false")).collect() == []

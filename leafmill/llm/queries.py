"""The registered queries of this subpackage; each applies one operator to its whole table. ORACLES: their DuckDB SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from leafmill.llm.bpe import decode_bpe, encode_bpe
from leafmill.llm.common import read_table
from leafmill.llm.merkle import merkle_proofs, proof_digest
from leafmill.llm.mixing import mix_sources
from leafmill.llm.near_dedup import near_duplicates
from leafmill.llm.page_diff import extract_pages
from leafmill.llm.parity_join import jaccard_groups
from leafmill.llm.pivot_search import exact_top_k
from leafmill.llm.prefix_trie import conversation_trie
from leafmill.llm.quality import fit_quality, quality_rules
from leafmill.llm.substring_dedup import dedup_substrings
from leafmill.llm.token_counts import count_tokens
from leafmill.llm.warc import archive_pages, read_archives
from leafmill.llm.wavelet import read_shards, write_shards

MAX_TOKENS = 4096


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_archives(archive_pages(read_table(spark, sf_dir, "pages")), with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(shards, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_rules(docs, model)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_bpe(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = decode_bpe(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    proofs = merkle_proofs(read_table(spark, sf_dir, "documents"), altered={"text": lowered}, where=tampered)
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_page_text": op3_page_text,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc": op5_warc,
    "op6_token_shards": op6_token_shards,
    "op7_token_counts": op7_token_counts,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_jaccard_join": op13_jaccard_join,
}



def groups_sql(shingle: int, percent: int, columns: str) -> str:
    """DuckDB SQL of op8 and op13: an inverted join of shingles, and the rows that links reach."""
    return rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, row, CASE WHEN len(w) >= {shingle} THEN list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: md5(array_to_string(w[i : i + {shingle - 1}], ' '))))
                           WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s FROM texts),
tokens AS (SELECT row, len(s) AS n, unnest(s) AS t FROM sets WHERE doc_id IS NOT NULL),
links AS (
  SELECT a.row AS x, b.row AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.row <> b.row AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT row AS x, row AS y FROM sets WHERE doc_id IS NOT NULL UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT r.x AS row, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.row = r.y GROUP BY r.x),
found AS (SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id, coalesce(s.doc_id = l.component_id, true) AS kept FROM sets s LEFT JOIN least l ON l.row = s.row)
SELECT {columns} FROM found"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB SQL."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    digits = f"list_transform(string_split({text}, ''), lambda d: ord(d)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda a, b: {step}), 4294967295)"


def merkle_sql(levels: int, group_levels: int) -> str:
    """DuckDB SQL of op11: one table a level, for groups of up to 16**levels rows."""
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    low = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    leaf, found = (f"sha256({' || '.join(part.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', t))})" for t in ("text", low))
    sql = [
        f"leaves AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN {found} END AS found FROM documents)",
        "l0 AS (SELECT source, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "t0 AS (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, *, coalesce(found, leaf) AS now, '' AS proof FROM leaves)",
    ]

    def rise(tree: str, k: int, keep: str, key: str) -> list[str]:
        return [
            f"""{tree}{k + 1} AS (SELECT {key}, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h, r // 16 AS r, (n + 15) // 16 AS n
            FROM {tree}{k} GROUP BY {key}, r // 16, n)""",
            f"""{keep}{k + 1} AS (SELECT t.* EXCLUDE (r, now, proof), t.r // 16 AS r,
              CASE WHEN s.n = 1 THEN now ELSE sha256(s.before || now || s.after) END AS now, proof || s.before || s.after AS proof
            FROM {keep}{k} t JOIN (SELECT {key}, r, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
              FROM {tree}{k} WINDOW w AS (PARTITION BY {key}, r // 16 ORDER BY r)) s ON t.{key} IS NOT DISTINCT FROM s.{key} AND t.r = s.r)""",
        ]

    for k in range(levels):
        sql += rise("l", k, "t", "source")
    sql += [
        f"g0 AS (SELECT 0 AS g, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM l{levels})",
        f"u0 AS (SELECT t.* EXCLUDE (r), g.g, g.r, g.h AS subroot FROM t{levels} t JOIN g0 g ON t.source IS NOT DISTINCT FROM g.source)",
    ]
    for k in range(group_levels):
        sql += rise("g", k, "u", "g")
    return f"""WITH {", ".join(sql)}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.h AS verified
FROM u{group_levels}, g{group_levels} root"""


ORACLES = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighted AS (SELECT source, source_size, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight FROM src),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source) AS k FROM weighted),
levels AS (
  SELECT k, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, source_size, weight FROM ordered),
level AS (SELECT rest, weights, k FROM levels WHERE rest * weight <= 3 * source_size * weights ORDER BY k LIMIT 1),
target AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.k < l.k THEN (3 * o.source_size)::DOUBLE ELSE l.rest::DOUBLE / l.weights::DOUBLE * o.weight::DOUBLE END AS target
  FROM ordered o, level l),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM target),
drawn AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('0:' || coalesce(s.doc_id::VARCHAR, '')), s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN before * 2 + size <= extra * 2 AND extra > 0 AND source_size > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM drawn""",
    "op2_exact_top_k": r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op4_substring_dedup": r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT row, doc_id, place, md5(array_to_string(w[place : place + 12], ' ')) AS h FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS place FROM texts)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows WHERE doc_id IS NOT NULL GROUP BY h),
gone AS (SELECT w.row, list_distinct(flatten(list(range(place, place + 13)))) AS places FROM windows w JOIN firsts f ON f.h = w.h AND f.first < w.doc_id GROUP BY w.row),
words AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM texts),
dropped AS (SELECT row, unnest(places) AS place FROM gone),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM words ANTI JOIN dropped USING (row, place) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.row = t.row""",
    "op5_warc": r"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda d: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', d)]), '') AS b,
         min(page_id) OVER (PARTITION BY hex) AS first FROM payloads)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substring(b, 5 * i + j + 1, 1)::INTEGER << (4 - j)))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits""",
    "op8_near_duplicates": groups_sql(5, 75, "*"),
    "op11_merkle_manifest": merkle_sql(levels=5, group_levels=3),
    "op12_prefix_trie": rf"""
WITH lists AS (
  SELECT conv_id::BIGINT AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.own[1 : {crc_sql("a.c::VARCHAR")} % 4], []), a.own[{crc_sql("a.c::VARCHAR")} % 4 + 1 :]) AS turns
  FROM lists a LEFT JOIN lists b ON b.c = a.c - a.c % 20),
paths AS (
  SELECT c, d, md5(turns[1 : d]::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(turns[1 : d - 1]::VARCHAR) END AS parent, len(turns) = d AS ending,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, min(c) AS first, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ending), '')) AS ends FROM paths GROUP BY node, d),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS n FROM nodes GROUP BY ALL) k ON k.parent = n.node AND k.d = n.d),
below AS (
  SELECT p.node, p.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM counted b JOIN paths p ON p.c = b.first AND p.d <= b.d GROUP BY p.node, p.d)
SELECT n.first AS conv_id, n.d::BIGINT AS depth, up.first AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM counted n JOIN below s ON s.node = n.node AND s.d = n.d LEFT JOIN nodes up ON up.node = n.parent AND up.d = n.d - 1""",
    "op13_jaccard_join": groups_sql(3, 90, "* EXCLUDE (kept)"),
}

"""Each operator against brute force and against the edge cases its docstring defines."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F


from leafmill.llm import bpe, mixing, near_dedup, page_diff, pivot_search, quality, substring_dedup, token_counts, warc, wavelet
from leafmill.llm.chunks import overlapping_chunks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size int, row int, bucket string, node int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeéfg"), rng.integers(1, 6))) for _ in range(n))


BASE = sentence(1, 120)
LONG = "\n".join(sentence(k, 400) for k in range(40)) + "  tail " + "x" * 3000
EDITED = " ".join("zz" if i in (7, 90) else w for i, w in enumerate(BASE.split()))
TEXTS = [
    (0, BASE), (1, BASE.upper()), (2, EDITED), (3, sentence(2, 60) + " " + BASE[:300]), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "One two"),
    (9, LONG), (10, LONG), (11, "día  漢字 x <|endoftext|> I'll\x1cgo end. 'S 'İ"), (12, sentence(3, 5) + " " + sentence(3, 5)), (12, sentence(4, 80)), (-3, BASE),
    (13, BASE), (13, BASE), (14, "\n".join(["same line here", " ", "same line here"] * 30)),
]
ROWS = [(i, t, f"s{i % 3}" if i != 5 else None, 1, 2, "b", 3) for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, (None, BASE, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORDS.findall(text or "")


# ---- 1 mixing -------------------------------------------------------------------------------------------------------


CONTENT = " ".join(f"w{k}" for k in range(30))


@pytest.mark.parametrize("start, end", [
    ("<form action=x>", "</form>"), ('<div id="menu-page">', "</div>"), ('<div class="related-work">', "</div>"), ('<div class="layout-no-sidebar">', "</div>"),
    ('<div class="content-sidebar">', "</div>"), ('<form><div class="menu-page"><div class="page-with-sidebar">', "</div></div></form>"),
])
def test_containers_do_not_take_the_article_away(start, end):
    page = f"<html><body>{start}<nav>menu a b</nav><article><p>{CONTENT}</article><div class=sidebar>side</div>{end}<footer>end</footer></body>"
    assert page_diff.main_text(page_diff.page_lines(page), set()) == CONTENT
    plain = f"<body>{start}<p>{CONTENT}</p><div class=sidebar>side</div>{end}<footer>f</footer>"
    assert page_diff.main_text(page_diff.page_lines(plain), set()) == CONTENT


def test_names_inside_an_article():
    for name in ["social-history", "share-price", "ad-hoc", "form-of-rule", "notice-period"]:
        assert page_diff.main_text(page_diff.page_lines(f'<article><p>a</p><div class="{name}">kept</div></article>'), set()) == "a kept"
    for name in ["share-buttons", "ad-slot-2", "related-posts", "newsletter_box", "social", "comments-area"]:
        assert page_diff.main_text(page_diff.page_lines(f'<article><p>a</p><div class="{name}">gone</div></article>'), set()) == "a"
    for page in (f'<article><p>a b</p></article><div class="comments">{CONTENT}</div>', f'<p>a b</p><div id="comments">{CONTENT}</div>'):
        assert page_diff.main_text(page_diff.page_lines(page), set()) == "a b"


@pytest.mark.parametrize("part", ["<svg ", "<math a='", "<form>", "<!-- ", "<a b=\"", "<div class=ad>"])
def test_pages_of_open_tags_take_linear_time(part):
    import time

    def seconds(n):
        start = time.process_time()
        page_diff.page_lines(part * n + "x")
        return time.process_time() - start

    assert seconds(40_000) < 12 * seconds(5_000) + 0.5


def test_mixing_reaches_capped_targets(spark):
    sizes = {"a": [10] * 2, "b": [5] * 40, "c": [7] * 30, None: [3] * 50}
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("text", "source")).collect()
    total = sum(map(sum, sizes.values()))
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(total)
    target = {r["source"]: r["target"] for r in got}
    assert target["a"] == 60  # clamped at three epochs
    rest = total - 60
    assert [target["b"], target["c"], target[None]] == pytest.approx([rest * w / 8 for w in (2, 1, 5)])
    for s, ns in sizes.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= max(ns)
    assert all(r["taken"] <= 3 * r["size"] and r["row"]["source"] == r["source"] for r in got)


def test_mixing_is_stable_and_takes_edge_rows(docs, empty):
    first, again = (sorted(mixing.mix_sources(docs.repartition(n)).collect(), key=str) for n in (1, 5))
    assert first == again and len(first) == docs.count()
    assert all(r["size"] == len(words(t)) for r in first for i, t in TEXTS if i == r["doc_id"] and i not in (12, 13))
    assert mixing.mix_sources(empty).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(empty.sparkSession.createDataFrame([(1, None, None)], "doc_id int, text string, source string")).collect()} == {0}


# ---- 2 exact top-k --------------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(300, 6)) * rng.uniform(0.1, 4, (300, 1)), np.tile(rng.normal(size=6), (150, 1))])
    rows = [(i, x.tolist(), 7) for i, x in enumerate(v)]
    odd = [(None, [1.0] * 6, 1), (1000, None, 1), (1020, [], 1), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1060, [float("nan")] * 6, 1), (1080, [float("inf")] * 6, 1), (1100, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, pivot int")
    got = sorted(tuple(r) for r in pivot_search.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())
    q = np.floor(64 * v).astype(np.int64)
    want = []
    for i in range(0, len(v), 20):
        ranked = sorted((-int(q[i] @ q[j]), j) for j in range(len(v)) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)]
    assert got == sorted(want)
    assert pivot_search.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    assert pivot_search.exact_top_k(df.where("vec_id < 3"), F.lit(True)).count() == 6


def test_top_k_passes_annuli_over(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centre = np.repeat(np.eye(8) * 50, 400, axis=0)
    v = centre + rng.normal(size=centre.shape)
    pivots = pivot_search._Pivots(np.floor(v[::400] * 64), int((np.floor(v * 64) ** 2).sum(axis=1).max()))
    ints = np.floor(v * 64)
    reach = pivots.reach(ints[:1], np.sort(ints[:1] @ ints.T)[:, -20])
    d = pivots.of_vectors(ints)
    assert (np.abs(d[:, 0] - pivots.of_queries(ints[:1])[0, 0]) > reach[0]).mean() > 0.5


# ---- 3 page differencing --------------------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div>"
    "<article><header><h1>Big &amp; bold</h1></header><p>One <b>t</b>wo<br>three<p>four &lt;x&gt;<div class=ad>Buy</div><aside>side</aside>"
    "<section id='comments'><p>me too</section><script>if (a<b) '</p>'</script></article><form>mail</form><footer>end</footer></body></html>"
)


def test_article_text():
    assert page_diff.main_text(page_diff.page_lines(PAGE), set()) == "Big & bold One two three four <x>"
    assert page_diff.main_text(page_diff.page_lines("<article><p>a &am<p>b &amp<b"), set()) == "a &am b &"
    assert page_diff.page_lines("") == [] and page_diff.page_lines("<!-- open <p>x") == []


@pytest.mark.parametrize("before", [
    "<html><head><title>t</title><meta charset=utf-8><style>p{}</style><body>", "<head><script>1</script></head>", "<head-line></head-line>", "<svg><g>", "<math>", "<object data=x>",
    "<svg><object></svg>", "<svg>no<svg>no</svg>no</svg>", "<title-x></title-x>", "<noscript>no</noscript ><template><p>no</template>", "<script>'<svg>'</script >", "<svg/>",
])
def test_what_is_not_closed_hides_nothing(before):
    assert page_diff.main_text(page_diff.page_lines(f"{before}<article><p>text</article>"), set()) == "text"


@pytest.fixture
def one_range(spark):
    """Pages at the edge of a range look to one side only, so the small table stays in one."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lines_shared_with_the_nearest_page_go(spark, one_range):
    page = "<body><div>Site name</div><div>{}</div><p>{}</p><div>All rights</div></body>"
    rows = [
        (1, "http://h.org/a/1", page.format("Part A", "first"), "x"), (2, "http://h.org/a/2", page.format("Part A", "second"), "x"),
        (3, "http://h.org/b/1", page.format("Part B", "third"), "x"), (4, "http://other.org/a/1", page.format("Part A", "alone"), "x"),
        (5, None, None, None), (None, "", "", ""), (6, "http://h.org/a/2", page.format("Part A", "second"), "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in page_diff.extract_pages(df).collect()}
    assert got == {1: "first", 2: "second", 6: "second", 3: "Part B third", 4: "Site name Part A alone All rights", 5: "", None: ""}
    assert page_diff.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_page_text_does_not_depend_on_ranges_or_copies(spark, partitions):
    page = "<body><div>Site name</div><div>{}</div><p>{}</p><div>All rights</div></body>"
    names = ["copy"] * 6 + ["a", "b"] + ["again"] * 8 + ["c"] + ["end"] * 5
    rows = [(k, f"http://h.org/x/{k:02}", page.format("Part A", n)) for k, n in enumerate(names)]
    rows += [(50 + k, "http://i.org/x", page.format("Part B", "same")) for k in range(4)] + [(None, "http://h.org/x/00", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r["page_id"]: r["text"] for r in page_diff.extract_pages(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows) and {k: got[k] for k in range(len(names))} == dict(enumerate(names))
    assert got[None] == "" and {got[50 + k] for k in range(4)} == {"Site name Part B same All rights"}


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        found = sorted(page_diff.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == table[-1, -1] and all(a[i] in rest for i in found)


# ---- 4 substring dedup ----------------------------------------------------------------------------------------------


def brute_substrings(rows, n=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substrings_against_brute_force(docs, empty):
    got = substring_dedup.dedup_substrings(docs, carry=("row", "bucket")).collect()
    known = [r for r in got if r["doc_id"] is not None]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in known) == brute_substrings(TEXTS)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)
    assert [(r["n_removed"], r["text"]) for r in got if r["doc_id"] is None] == [(0, BASE)]
    assert substring_dedup.dedup_substrings(empty).count() == 0


# ---- 5 WARC ---------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "é" * 50_000
    rows = [(3, "u\n%", "same", 1), (1, "u", "same", 1), (2, None, big, 1), (9, "u", big, 1), (4, "u", None, 1), (5, "u", "", 1), (None, "u", "same", 1), (1, "v", "same", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    chunks = warc.read_archives(warc.archive_pages(df, archive_bytes=200), chunk_bytes=1 << 14).collect()
    last = [r for r in chunks if r["last"]]
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    text = {p: t for p, _, t, _ in rows}
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in last) == [
        (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0), (3, "revisit", 1), (4, "response", 0), (5, "revisit", 4), (9, "revisit", 2),
    ]
    assert all((r["payload_bytes"], r["payload_digest"]) == (len((text[r["page_id"]] or "").encode()), sha(text[r["page_id"]])) for r in last)
    parts = sorted((r["chunk_no"], r["data"]) for r in chunks if r["page_id"] == 2)
    assert len(parts) == 7 and b"".join(d for _, d in parts).decode() == big
    assert {r["url"] for r in last if r["page_id"] in (2, 3)} == {None, "u\n%"}
    none = warc.read_archives(warc.archive_pages(df, min_bytes=10)).where("last").collect()
    assert sorted(r["page_id"] for r in none if r["record_type"] == "revisit") == [9]
    assert warc.read_archives(warc.archive_pages(df.limit(0))).count() == 0


def test_a_damaged_archive_is_no_silent_loss():
    whole = io.BytesIO()

    class Sink:
        def open_output_stream(self, _):
            whole.close = lambda: None
            return whole

    archive = warc._Archive(Sink(), "x")
    archive.write([("WARC-Type", "response")], memoryview(b"payload"))
    archive.close()
    assert [r["data"] for r in warc.read_records(io.BytesIO(whole.getvalue()))] == [b"payload"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole.getvalue()[:-12])))


# ---- 6 token shards -------------------------------------------------------------------------------------------------


def test_shards_hold_the_library_ids_in_order(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    odd = ["Σίσυφος ΟΔΟΣ.", "á, é. İx. ǅz, ß. don't we'LL 3.14,", "ẞͅ Å. 한국어, ﬁn.", "x.y,. ., .", "한‍­."]
    df = docs.unionByName(spark.createDataFrame([(100 + k, t, "s", 0, 0, "", 0) for k, t in enumerate(odd)], DOCS))
    manifest = wavelet.write_shards(df, WORD_BPE, shard_tokens=3000)
    got = sorted(wavelet.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 1 and [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert got[-1]["doc_id"] is None
    texts = defaultdict(list)
    for i, t in [*TEXTS, *((100 + k, t) for k, t in enumerate(odd)), (None, BASE)]:
        texts[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in texts[r["doc_id"]] and (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(r["ids"]))
        at += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(empty, WORD_BPE)).count() == 0


def test_words_with_marks_are_cut_once():
    """Marks behind a plain word are encoded apart, each run of them once, and the ids are the library's."""
    cache = wavelet.WordCache(WORD_BPE)
    whole, calls = cache._whole, []

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return whole.encode(text, **options)

    cache._whole = Counted()
    stems = [a + b for a in ("Zeit", "\u00e9t\u00e9", "word") for b in ("abc", "xyz", "qq", "\u00fc")]
    text = " ".join(s + m for s in stems for m in ("***", ".", ",&&&", "$$$", "%%%", ".."))
    assert cache.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 6


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 1), (700, 1), (513, 2), (5000, 700)])
def test_wavelet_matrix_answers(n, kinds):
    x = np.random.default_rng(n).integers(0, kinds, n) * 5
    m = wavelet.WaveletMatrix.build(x)
    m, docs, known, lengths = wavelet.from_file(wavelet.to_file(m, np.array([4, 9]), np.array([True, False]), np.array([n, 0])))
    assert (m.ids() == x).all() and (m.access(np.arange(n)) == x).all() and lengths.tolist() == [n, 0] and known.tolist() == [True, False]
    for token in {*x[:5].tolist(), 3}:
        assert m.count(token, n // 4, n // 2) == (x[n // 4 : n // 2] == token).sum()
        if token != 3:
            assert m.occurrences(token).tolist() == np.flatnonzero(x == token).tolist()


# ---- 7 and 10 tokens ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1 << 15, 700])
def test_counts_and_ids_are_the_library_ones(docs, empty, chunk):
    counts = token_counts.count_tokens(docs, PIECES, chunk=chunk, overlap=3).collect()
    model = token_counts.load_model(PIECES)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in [*TEXTS, (None, BASE)])
    assert Counter(map(tuple, counts)) == want
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    encoded = bpe.encode_bpe(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=3)
    got = bpe.decode_bpe(encoded, RANKS, public_tokenizers.PATTERN).collect()
    ids = lambda t: np.asarray(encoding.encode_ordinary(t or ""), "<u4").tobytes()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, ids(t), (t or "").encode()) for i, t in [*TEXTS, (None, BASE)])
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert token_counts.count_tokens(empty, PIECES).count() == bpe.encode_bpe(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- 8 near duplicates ----------------------------------------------------------------------------------------------


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_groups_against_brute_force(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute_groups(TEXTS)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_a_chain_and_a_crowd_of_near_copies(spark):
    """Each text of the chain is linked with its neighbours only; the crowd is many edits of one text, some too far off."""
    rng = np.random.default_rng(8)
    base = sentence(50, 200).split()
    chain = [(k, " ".join([f"q{k}x{j}" if j < 12 * k else w for j, w in enumerate(base)])) for k in range(8)]
    crowd = []
    for k in range(100, 160):
        w = sentence(51, 200).split()
        for place in rng.integers(0, 200, rng.integers(0, 9)):
            w[place] = f"e{k}"
        crowd.append((k, " ".join(w)))
    rows = chain + crowd
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows)


def test_blocks_of_a_bucket_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    samples = np.tile(near_dedup.min_hashes(np.arange(1, 50, dtype=np.uint64) << np.uint64(40), 1024), (10, 1))
    sharp, bands = near_dedup.odd_sketches(samples, near_dedup.SHARP), near_dedup.band_keys(samples[:, :128])
    rows = [(int(bands[k][j]), k, 0 if k < 6 else k, 0, 49, bytearray(sharp[k].tobytes()), bands[k].tolist(), 10) for k in range(10) for j in (0, 3)]
    df = spark.createDataFrame(rows, "key long, nid long, comp long, main long, n long, sharp binary, bands array<long>, size long")
    pairs = [tuple(sorted(r)) for r in near_dedup._pairs_across(df, 75).collect()]
    assert len(pairs) == len(set(pairs)) == 4 * 6 + 6


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1400).astype(np.uint64)
    a, b = np.unique(pool[:1200]), np.unique(pool[200:1400])  # similarity 5 / 7
    x, y = (near_dedup.odd_sketches(near_dedup.min_hashes(s, 1024)[None], near_dedup.SHARP).view(np.uint64) for s in (a, b))
    bits = int(np.bitwise_count(x ^ y).sum())
    assert abs(bits - near_dedup.expected_bits(5 / 7, *near_dedup.SHARP)) < 100


# ---- 9 quality ------------------------------------------------------------------------------------------------------


def brute_counts(text):
    w, t = words(text), text or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_quality_counts_against_brute_force(docs, empty):
    got = quality.quality_rules(docs, None, carry=("row",)).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:7]) for r in got) == Counter((i, *brute_counts(t)) for i, t in [*TEXTS, (None, BASE)])
    assert all(r["kept"] == (not r["base_failed"]) and r["p_good"] is None for r in got)
    assert quality.quality_rules(empty, None).count() == 0


def test_quality_model_on_held_out_rows(spark):
    rows = [(k, sentence(k, 70) if k % 3 else " ".join(w + "###" for w in sentence(k, 70).split())) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*((k, int(k % 3 > 0)) for k in range(200)), (None, 1), (7000, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    got = quality.quality_rules(df.where("doc_id >= 200"), model).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    assert quality.fit_quality(df, labels.where("quality = 1")) is None and quality.fit_quality(df, labels.limit(0)) is None


@pytest.mark.parametrize("size", [50_000, 200_000])
def test_a_stretch_without_boundaries_is_shuffled_once(spark, size):
    """The pieces of a text are together little longer than it, and counts and ids stay those of the library."""
    texts = ["x" * size + " y", "a b " + "x" * size + " y" * 3000, "x" * size, "w " * (size // 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for boundary in (token_counts.STABLE, bpe.STABLE):
        pieces = overlapping_chunks(docs, boundary, 8192, 256).groupBy("row").agg(F.sum(F.length("piece")).alias("n")).collect()
        assert all(r["n"] <= 1.2 * len(texts[r["row"]]) for r in pieces)


def test_counts_of_texts_with_one_boundary(spark):
    texts = ["xy" * 9000 + " y", "go " * 50 + "xy" * 9000 + " y" * 300, " " * 6000 + "a", "a" + " " * 6000 + "b" * 6000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, encoding = token_counts.load_model(PIECES), bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PIECES, chunk=1000, overlap=16).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_bpe(docs, RANKS, public_tokenizers.PATTERN, chunk=1000, overlap=16).collect()}
    assert ids == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}


def test_chunks_that_do_not_align_are_encoded_whole(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "tokens_between", lambda *_: None)
    docs = spark.createDataFrame([(1, "some words " * 400), (2, "short"), (2, "more words " * 400)], "doc_id long, text string")
    model = token_counts.load_model(PIECES)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, PIECES, chunk=1000, overlap=16).select("doc_id", "n_tokens").collect())
    assert got == sorted((i, len(model.encode(t))) for i, t in [(1, "some words " * 400), (2, "short"), (2, "more words " * 400)])


def test_near_duplicates_of_many_texts_under_one_id(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join([*base[:k], "z", *base[k + 1 :]])) for k in range(60)] + [(2, "other " * 20), (1, sentence(5, 50))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({r["group_id"] for r in got}) == 3


def test_band_keys_and_sets_are_not_broadcast(spark, monkeypatch):
    from leafmill.llm import near_dedup

    plans = []
    write = near_dedup.stage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(near_dedup, "stage", seen)
    words = [f"w{k * k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[: 60 - k % 3])) for k in range(9)], "doc_id long, text string")
    near_dedup.near_duplicates(docs).collect()
    keyed = [p for p in plans if "explode(bands" in p]
    assert keyed and all("BroadcastHashJoin [key" not in p for p in keyed)
    confirmed = [p for p in plans if "array_intersect" in p]
    assert confirmed and all(f"BroadcastHashJoin [{side}" not in p for p in confirmed for side in "xy")

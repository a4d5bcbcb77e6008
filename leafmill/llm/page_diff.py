"""HTML extraction by nearest-URL page differencing: pages next to each other by URL path share their boilerplate lines."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import lean, stage

#: fixed values: element names as HTML defines them
RAW = "script style textarea iframe title".split()
#: elements that are passed over with all they hold, but only up to an end tag of their own
HELD = "noscript template object svg math".split()
BREAKS = (
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: elements that may end without an end tag
LOOSE = "p li dt dd td th tr thead tbody tfoot option optgroup colgroup".split()

#: elements, roles and class or id names of what is not the article
ASIDE_TAGS = "nav aside footer form header menu dialog button select search".split()
ASIDE_ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
_NAMES = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar comment comments commentlist replies respond discussion disqus cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager widget toolbar form skip"
).split()
_LAST = "ad ads advert nav menu sidebar footer header notice notices banner comments comment form breadcrumbs popup modal".split()
ASIDE_NAME = re.compile(rf"(?:{'|'.join(_NAMES)})(?:[-_].*)?|(?!(?:has|with|no|without|is|show|hide)[-_]).*[-_](?:{'|'.join(_LAST)})", re.I)
#: inside an article a name with more parts is that of an aside only if these are layout words or such names, too
_LAYOUT = (
    "area bar block body bottom box btn button buttons card cards center close col column container content desktop feed footer global group header heading icon icons inner "
    "item items label large layer left link links list main media message mobile module more outer overlay page panel post posts primary right row secondary section site slot "
    "small sticky stories story strip tab table tag tags text title tools top unit widget wrap wrapper zone"
).split()
INNER_NAME = re.compile(rf"(?:{'|'.join(_NAMES)})(?:[-_]+(?:{'|'.join(_NAMES + _LAYOUT)}|\d+))*[-_]*|(?!(?:has|with|no|without|is|show|hide)[-_]).*[-_](?:{'|'.join(_LAST)})", re.I)
#: asides by such names are none of a page's text, however long they are
NEVER_TEXT = re.compile(r"(?:.*[-_])?(?:comment|repl|respond|discussion|disqus|cookie|consent|gdpr|popup|modal|overlay).*", re.I)
HEADING_NAME = re.compile(r"(?:.*[-_])?header(?:[-_].*)?", re.I)

_RAW = rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
HOLDER = re.compile(rf"{_RAW}|<(/?)({'|'.join(HELD)})(?=[\s/>])[^>]*>", re.S | re.I)
TOKEN = re.compile(
    rf"{_RAW}|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

NEUTRAL, ARTICLE, MAIN, ASIDE = range(4)
CONTAINERS = 8
#: pages stand in this order; `hash` is that of the html
ORDER = ["host", "path", "page_id", "hash"]
_BREAKS, _VOID, _LOOSE, _ASIDE_TAGS, _ROLES = map(frozenset, (BREAKS, VOID, LOOSE, ASIDE_TAGS, ASIDE_ROLES))


def _aside(tag: str, attributes: str, in_article: bool) -> str | None:
    """Why an element is not the article: its tag, a role, that it is hidden, or the class or id name; None if it may be."""
    if tag in _ASIDE_TAGS and not (tag == "header" and in_article):
        return f"<{tag}>"
    if not attributes or tag in ("html", "body", "main"):
        return None
    names = INNER_NAME if in_article else ASIDE_NAME
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next(filter(None, values), ""), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "<hidden>"
        for word in value.split():
            if name == "role":
                if word.lower() in _ROLES:
                    return "<role>"
            elif name != "aria-hidden" and names.fullmatch(word):
                if tag == "article" and not word.lower().startswith(("comment", "repl", "ad", "promo", "sponsor", "related")):
                    continue
                if not (in_article and HEADING_NAME.fullmatch(word)):
                    return word
    return None


def without_held(source: str) -> str:
    """The page without the elements of HELD; the tags of one that is never closed stay, and so does what follows it."""
    opened: dict[str, list[int]] = {name: [] for name in HELD}
    spans: list[tuple[int, int]] = []
    # without a further > nothing closes
    for token in HOLDER.finditer(source, 0, source.rfind(">") + 1):
        if name := token.group(3):
            starts = opened[name.lower()]
            if not token.group(2):
                if not token.group().endswith("/>"):
                    starts.append(token.start())
            elif starts:
                spans.append((starts.pop(), token.end()))
    kept, at = [], 0
    for start, end in sorted(spans):
        kept.append(source[at:start])
        at = max(at, end)
    return "".join(kept) + source[at:]


def page_lines(source: str) -> list[tuple[str, int]]:
    """Lines of a page, one for every block with text, each with the part of the page it stands in.

    Markup, comments, scripts, styles and unfinished tags at the end give no text. A head may lack its end tag, and a
    drawing, formula or object without one hides nothing that follows. White space inside a block becomes one
    space and character references are decoded.

    A form, or an element that is an aside by its name only, may hold the page itself (`page-with-sidebar`). So one that
    has more than half of the words is none, if it has the page's only article, or if the page has no article or main part.
    Up to `CONTAINERS` of them may stand inside one another.
    """
    source = without_held(source)
    pardoned: set[int] = set()
    while True:
        lines, asides = _lines(source, pardoned)
        words: dict[int | None, int] = {}
        for text, _, aside in lines:
            words[aside] = words.get(aside, 0) + len(text.split())
        kinds = {kind for _, kind, _ in lines}
        most = max((a for a in words if a is not None), key=lambda a: words[a], default=None)
        # what holds an article counts before a main part, an aside of comments or notices never
        free = most is not None and ARTICLE not in kinds and (asides[most][1] or MAIN not in kinds)
        if len(pardoned) == CONTAINERS or not free or 2 * words[most] <= sum(words.values()) or (asides[most][0] != "<form>" and (asides[most][0][0] == "<" or NEVER_TEXT.fullmatch(asides[most][0]))):
            return [(text, kind) for text, kind, _ in lines]
        pardoned.add(most)


def _lines(source: str, pardoned: set[int]) -> tuple[list[tuple[str, int, int | None]], dict[int, list]]:
    """(text, part, place of the aside or None) of every line, and for every aside why it is one and whether it has an
    article. Elements that start at a place in `pardoned` are no asides."""
    lines: list[tuple[str, int, int | None]] = []
    asides: dict[int, list] = {}
    stack: list[tuple[str, int, int | None]] = []
    held: list[str] = []
    at, part, aside = 0, NEUTRAL, None

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                lines.append((text, part, aside))
            held.clear()

    for token in TOKEN.finditer(source):
        if token.start() > at:
            held.append(source[at : token.start()])
        at = token.end()
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        breaks = tag in _BREAKS
        if breaks:
            flush()
        if token.group(2):
            if any(t == tag for t, *_ in stack):
                while stack.pop()[0] != tag:
                    pass
                flush()
        elif tag not in _VOID:
            if breaks and stack and stack[-1][0] in _LOOSE and (stack[-1][0] == "p" or stack[-1][0] == tag):
                stack.pop()  # a paragraph ends at the next block, an item at the next item
            inherited, within = stack[-1][1:] if stack else (NEUTRAL, None)
            kind = inherited
            if inherited == ASIDE:
                if tag == "article" and not _aside(tag, token.group(4), False):
                    asides[within][1] = True
            else:
                if token.start() not in pardoned and (why := _aside(tag, token.group(4), inherited == ARTICLE)):
                    kind, within = ASIDE, token.start()
                    asides[within] = [why, False]
                elif tag == "article":
                    kind = ARTICLE
                elif tag == "main" and inherited == NEUTRAL:
                    kind = MAIN
            if kind != inherited or tag not in _LOOSE:
                if kind != inherited:
                    flush()
                if breaks or kind != inherited:
                    stack.append((tag, kind, within))
        part, aside = stack[-1][1:] if stack else (NEUTRAL, None)
    held.append(source[at:])
    flush()
    return lines, asides


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in `a` of a longest common subsequence of two lists of lines.

    Common beginnings and ends are taken off first; between them the matching places are chained by binary search, so the
    cost follows the number of matches.
    """
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = {*range(first), *range(len(a) - last, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(first, len(b) - last):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple[int, object]] = []
    for i in range(first, len(a) - last):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def nearness(path: str, other: str) -> tuple[int, int]:
    """Equal leading path segments, then equal leading characters."""
    a, b = path.split("/"), other.split("/")
    segments = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    characters = next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
    return segments, characters


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """Joins what is left of a page: its articles if it has any, else its main part, else all of it; never an aside.

    Lines shared with the neighbour go, except inside an article: a passage that two articles quote, or the whole of a
    page that is there twice, is text and not boilerplate.
    """
    kinds = {kind for _, kind in lines}
    wanted = next((k for k in (ARTICLE, MAIN) if k in kinds), NEUTRAL)
    return " ".join(t for i, (t, kind) in enumerate(lines) if kind == wanted and (wanted == ARTICLE or i not in shared))


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Main text of every page. Returns one row per input row: page_id, url, text, n_chars (code points), n_shared (lines
    the page shares with its neighbour), neighbour (its page_id).

    Pages are ordered by (host, path, page_id, hash of the html) and cut into ranges, so a host with a third of all pages
    is spread over many tasks. A page's neighbour is the nearest page before or after it, of the same host and with
    another text, with more of its path in common (the one before on a tie). Their lines are aligned by longest common
    subsequence and shared lines are deleted; pages without text are no neighbours. What differencing cannot see is told from the markup: menus, adverts and
    the like that differ from page to page are asides by element, role or class name, and lines of an article are never
    boilerplate. Pages that are copies by text share everything and are no neighbours; they look past each other.

    Two passes over the pages: the first writes keys and hashes to the shared folder and finds the ranges and, for each,
    the differing page before and after it (two keys a range reach the driver); the second sends the pages to their
    ranges and those edge pages along, so the result does not depend on the number of ranges.

    Edge cases: null and empty html give an empty text; a null url has host and path empty; a lone page of a host is not
    compared; null and repeated keys are ordinary rows; an empty table gives an empty result; other columns are ignored.
    """
    site = F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), site.alias("host"), path.alias("path"), F.xxhash64(source).alias("hash"))
    key_type, url_type = dict(rows.dtypes)["page_id"], dict(rows.dtypes)["url"]
    schema = f"page_id {key_type}, url {url_type}, text string, n_chars long, n_shared int, neighbour {key_type}"
    firsts, edges = _ranges(rows, key_type)

    def place(keys: list[tuple]) -> list[Column]:
        return [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(ORDER, k, ("string", "string", key_type, "long"))]) for k in keys]

    own = F.struct(*ORDER)
    number = F.size(F.filter(F.array(*place(firsts)), lambda first: first <= own)) - 1 if len(firsts) > 1 else F.lit(0)
    sent = F.array(F.struct(number.alias("range"), F.lit(False).alias("edge")))
    if edges:
        beside = [F.struct(F.lit(r).alias("range"), k.alias("key")) for (r, _), k in zip(edges, place([k for _, k in edges]))]
        met = F.filter(F.array(*beside), lambda e: e["key"].eqNullSafe(own))
        sent = F.concat(sent, F.transform(met, lambda e: F.struct(e["range"].alias("range"), F.lit(True).alias("edge"))))
    dealt = rows.withColumn("sent", F.explode(sent)).select("page_id", "url", "html", "host", "path", "hash", "sent.edge", "sent.range")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        kinds = None

        def done(run: dict, before: dict | None, after: dict | None) -> None:
            """The pages of a run of copies, between the runs before and after it."""
            sides = [p for p in (before and {**before["last"], "texts": before["texts"]}, after and {**after["first"], "texts": after["texts"]}) if p]
            sides = [p for p in sides if p["host"] == run["host"]]
            shared: dict[int, set[int]] = {}
            found: dict[tuple, str] = {}
            for page in run["pages"]:
                k = max(range(len(sides)), key=lambda k: nearness(page["path"], sides[k]["path"]), default=-1)
                if k not in shared:
                    shared[k] = shared_lines(run["texts"], sides[k]["texts"]) if sides else set()
                at = (k, page["parts"])
                if at not in found:
                    found[at] = main_text(list(zip(run["texts"], page["parts"])), shared[k])
                text = found[at]
                out.append({"page_id": page["page_id"], "url": page["url"], "text": text, "n_chars": len(text), "n_shared": len(shared[k]), "neighbour": sides[k]["page_id"] if sides else None})

        before = run = None
        for batch in batches:
            kinds = kinds or pa.schema([batch.schema.field("page_id"), batch.schema.field("url"), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int32()), batch.schema.field("page_id").with_name("neighbour")])
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                page = {c: column[i].as_py() for c, column in columns.items()}
                lines = page_lines(page.pop("html") or "")
                texts = [t for t, _ in lines]
                page["parts"] = bytes(kind for _, kind in lines)
                if not lines:
                    out.append({"page_id": page["page_id"], "url": page["url"], "text": "", "n_chars": 0, "n_shared": 0, "neighbour": None})
                    continue
                if not (run and run["host"] == page["host"] and run["texts"] == texts):
                    following = {"host": page["host"], "texts": texts, "first": page, "pages": []}
                    if run:
                        done(run, before, following)
                    before, run = run, following
                    if before:
                        before["pages"] = []
                run["last"] = page
                if not page["edge"]:
                    run["pages"].append(page)
                while len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out[:256], schema=kinds)
                    del out[:256]
        if run:
            done(run, before, None)
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(out[at : at + 256], schema=kinds)

    return dealt.repartitionById(max(1, len(firsts)), F.col("range")).sortWithinPartitions(*ORDER).mapInArrow(lean(extract), schema)


def _ranges(rows: DataFrame, key_type: str) -> tuple[list[tuple], list[tuple[int, tuple]]]:
    """The first key of every range, and (range, key) of the pages of other ranges that its ends are compared with.

    These are the last page before the range and the first one after it that are of the host and not of the text of its
    first and last page.
    """
    keys = f"host string, path string, page_id {key_type}, hash long, copy long"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [page_lines(h.as_py() or "") for h in batch.column("html")]
            copies = [_text_hash(of_page) if of_page else None for of_page in lines]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ORDER], pa.array(copies, pa.int64())], [*ORDER, "copy"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = first = second = last = other = None
        schema = None
        for batch in batches:
            schema = batch.schema
            for page in batch.to_pylist():
                start = start or page
                if page["copy"] is None:
                    continue
                if first is None:
                    first = page
                elif second is None and page["host"] == first["host"] and page["copy"] != first["copy"]:
                    second = page
                if last and (page["host"] != last["host"] or page["copy"] != last["copy"]):
                    other = last if page["host"] == last["host"] else None
                last = page
        if start:
            none = dict.fromkeys(schema.names)
            yield pa.RecordBatch.from_pylist([start, *[page or none for page in (first, second, last, other)]], schema=schema)

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = stage(rows.select(*ORDER, "html").mapInArrow(lean(describe), keys))
    index = index.repartitionByRange(max(1, min(count, index.count())), *ORDER).sortWithinPartitions(*ORDER)
    found = index.mapInArrow(ends, keys).withColumn("place", F.monotonically_increasing_id()).collect()
    found.sort(key=lambda r: r["place"])
    starts = found[::5]
    # of the pages with text: the first, the first that differs from it, the last, the last that differs from it
    parts = [found[i + 1 : i + 5] for i in range(0, len(found), 5)]
    name = lambda r: tuple(r[c] for c in ORDER)

    def beyond(r: int, step: int) -> tuple | None:
        here = parts[r][0] if step < 0 else parts[r][2]
        near, differing, far = (2, 3, 0) if step < 0 else (0, 1, 2)
        q = r + step
        while here["copy"] is not None and 0 <= q < len(parts):
            if parts[q][near]["copy"] is not None:
                if parts[q][near]["host"] != here["host"]:
                    return None
                if parts[q][near]["copy"] != here["copy"]:
                    return name(parts[q][near])
                if parts[q][differing]["copy"] is not None:
                    return name(parts[q][differing])
                if parts[q][far]["host"] != here["host"]:
                    return None
            q += step
        return None

    edges = [(r, k) for r in range(len(parts)) for k in (beyond(r, -1), beyond(r, 1)) if k]
    return [name(r) for r in starts], edges


def _text_hash(lines: list[tuple[str, int]]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(t for t, _ in lines).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

"""HTML extraction by nearest-URL page differencing.

A page is cut into text lines at block borders. Pages are ordered by host, URL path, page_id and content; a page's nearest
URLs are its ``NEAR`` neighbours on either side within its host. The lines of the page are aligned with each neighbour's by a
longest common subsequence, and a line that at least two neighbours share (or the only one) is deleted as template. A
neighbour with the very same lines is a copy and no evidence.

Neighbours are found whatever the partitioning: the short keys alone are ranked, every block of ranks gets the rows next to its
borders as well, and one shuffle deals the parsed lines to blocks. The borders are a few keys of bounded length for each of at
most ``MOST_BLOCKS`` blocks. A host of any size spreads over blocks.

Markup has a veto either way, since differencing alone is wrong in two ways here. Copied articles share their own lines with
neighbours: lines inside ``article`` or ``main`` are kept. And boilerplate that differs from page to page is shared with no
neighbour: lines inside elements that hold menus, headers, footers, sidebars, notices, adverts, forms or comments, by tag name
or by a word of class, id or role, are deleted as well. Ids of headings and sections inside an ``article`` or ``main`` name
their subject and mark nothing, but for a section's id that is just ``comment`` or ``comments``. ``n_shared``, ``n_marked`` and
``n_kept_shared`` count the lines that differencing deleted, that only markup deleted, and that markup kept though shared.

Defined cases: a null or empty html gives the empty text; broken, unclosed and upper-case markup is read leniently (an
unclosed script hides the rest of the page); a null url has empty host and path; a page that is its host's only one is not
differenced, only bounded by its markup; repeated rows each keep their row and are one page to their neighbours; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import numbered, table
from spanloom.llm.url_filter import split_url

#: Tag names, and words of class, id or role that mark boilerplate.
DROPPED = set("nav header footer aside form script style noscript template iframe svg math canvas object audio video button select textarea dialog menu head title".split())
RAW = set("script style textarea title noscript iframe template svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
COMMENT = {"comment", "comments"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = set(
    "nav navbar navigation menu header footer sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion notice cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs pagination comment comments disqus toolbar widget "
    "copyright search contentinfo complementary".split()
)
#: Words that make a class a property of the page's layout, and elements that the next of their kind closes.
LAYOUT = set("has with without no hide show".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>|<[!?][^>]*>""", re.S)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(_HINT.pattern.replace("class|id|role", "class|role"), re.I)
_ID = re.compile(_HINT.pattern.replace("class|id|role", "id"), re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BOILER, OPEN, CORE = 0, 1, 2
NEAR = 2
BLOCK_ROWS, MOST_BLOCKS = 512, 1 << 16
KEY_CHARS = 256
LCS_CELLS = 1 << 26


def _hinted(attrs: str, words: set[str] = BOILERPLATE, names: re.Pattern = _HINT) -> bool:
    for m in names.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            own = {w.lower() for w in _WORD.findall(name)}
            if own & words and not own & LAYOUT:
                return True
    return False


def _marked(tag: str, attrs: str, stack: list[tuple[str, int]]) -> bool:
    """Whether class, id or role mark boilerplate, given the open elements."""
    if tag in MAIN:
        return _hinted(attrs, COMMENT)
    if stack and stack[-1][1] == CORE:
        if tag in HEADINGS or any(t in HEADINGS for t, _ in stack):
            return _hinted(attrs, names=_CLASS)
        if tag == "section":
            return _hinted(attrs, names=_CLASS) or any((m[1] or m[2] or m[3] or "").strip().lower() in COMMENT for m in _ID.finditer(attrs))
    return _hinted(attrs)


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the page's lines in order; kind: BOILER, OPEN or CORE."""
    page = page or ""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements, and the kind of text within each

    def end() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, stack[-1][1] if stack else OPEN))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None:
                end()
                del stack[place:]
            elif tag not in INLINE:
                end()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        drop = tag in DROPPED or (tag not in ("html", "body") and bool(attrs) and _marked(tag, attrs, stack))
        if tag in INLINE and not drop:
            continue
        end()
        if tag in RAW and not attrs.endswith("/"):  # its content is not markup
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in VOID or attrs.endswith("/"):
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY.get(tag, ())):  # end tags that may be left out
            stack.pop()
        kind = stack[-1][1] if stack else OPEN
        stack.append((tag, BOILER if drop or kind == BOILER else CORE if tag in MAIN else kind))
    end()
    return out


def _masks(b: list[int], wanted: set[int]) -> dict[int, int]:
    """For each symbol of ``wanted``, the bit set of its places in ``b``."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        if x in wanted:
            places.setdefault(x, []).append(j)
    out = {}
    for x, at in places.items():
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit vectors of the LCS table, a row for each symbol of ``a``: a bit is 0 where the length grows with that symbol of ``b``."""
    masks, full = _masks(b, set(a)), (1 << len(b)) - 1
    v = full
    for x in a:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
        yield v


def _growth(v: int, n: int) -> np.ndarray:
    """LCS lengths with the first 0 to n symbols of ``b``, from a row's bits."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in ``a`` and in ``b`` of one longest common subsequence.

    Rows of the table are bit vectors, so repeated lines cost no more than others; above ``LCS_CELLS`` cells ``a`` is halved
    and ``b`` cut where the halves' lengths sum to most, so that memory stays linear.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    left, right = _middle(a[lo:x], b[lo:y])
    head, tail = list(range(lo)), len(a) - x
    return head + [lo + i for i in left] + list(range(x, len(a))), head + [lo + j for j in right] + list(range(y, y + tail))


def _middle(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    if not a or not b:
        return [], []
    if len(a) * len(b) > LCS_CELLS and len(a) > 1:
        half, top, bottom = len(a) // 2, 0, 0
        for top in _rows(a[:half], b):
            pass
        for bottom in _rows(a[half:][::-1], b[::-1]):
            pass
        cut = int((_growth(top, len(b)) + _growth(bottom, len(b))[::-1]).argmax())
        left, right = common(a[:half], b[:cut])
        more, rest = common(a[half:], b[cut:])
        return left + [half + i for i in more], right + [cut + j for j in rest]
    size = (len(b) + 7) // 8
    rows = [v.to_bytes(size, "little") for v in _rows(a, b)]
    i, j, left, right = len(a), len(b), [], []
    while i and j:
        k, bit = (j - 1) >> 3, 1 << ((j - 1) & 7)
        if rows[i - 1][k] & bit:  # no growth with this symbol of b
            j -= 1
        elif i > 1 and not rows[i - 2][k] & bit:  # the row above grows here too
            i -= 1
        else:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
    return left[::-1], right[::-1]


def shared_lines(own: list[str], neighbours: list[list[str]]) -> set[int]:
    """Numbers of the lines that two neighbours that are no copies share, or the only one does."""
    number: dict[str, int] = {}
    code = lambda text: [number.setdefault(t, len(number)) for t in text]
    a, counts = code(own), [0] * len(own)
    others = [b for b in map(code, neighbours) if b != a]
    for b in others:
        for i in common(a, b)[0]:
            counts[i] += 1
    need = min(2, len(others))
    return {i for i, n in enumerate(counts) if n and n >= need}


def extract(own: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> tuple[str, int, int, int]:
    """The page's text, and the lines deleted by differencing, deleted by markup only, and kept by markup though shared."""
    shared = shared_lines([t for t, _ in own], [[t for t, _ in n] for n in neighbours])
    text = " ".join(t for i, (t, k) in enumerate(own) if k == CORE or (k == OPEN and i not in shared))
    kept = sum(own[i][1] == CORE for i in shared)
    return text, len(shared) - kept, sum(k == BOILER and i not in shared for i, (_, k) in enumerate(own)), kept


def _borders(keys: DataFrame, block_rows: int) -> list[tuple[tuple, tuple, tuple]]:
    """For each block of ranks but the first: its first key, the key ``NEAR`` ranks before it and the last of ``NEAR`` ranks in it."""
    ranked = numbered(keys.distinct(), keys.columns, "rank")
    n = ranked.count()
    size = max(block_rows, NEAR, -(-n // MOST_BLOCKS))
    at = F.col("rank") % size
    near = ranked.where((at == 0) | (at == size - NEAR) | (at == NEAR - 1) | (F.col("rank") == n - 1))
    by = {r[-1]: tuple(r)[:-1] for r in near.collect()}
    return [(by[i], by[i - NEAR], by[min(i + NEAR - 1, n - 1)]) for i in range(size, n, size)]


def extract_pages(pages: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """page_id, url, text, paired (neighbours were aligned), n_shared, n_marked, n_kept_shared for every row of ``pages`` (page_id, url, html)."""
    import zstandard

    host, path = split_url(F.col("url"))
    kind, id_kind = pages.schema["page_id"].dataType.simpleString(), pages.schema["page_id"].dataType
    short = lambda c: F.when(F.char_length(c) <= KEY_CHARS, c).otherwise(F.concat(F.left(c, F.lit(KEY_CHARS)), F.hex(F.xxhash64(c))))
    keyed = pages.select(
        "page_id", "url", host.alias("host"), "html", short(host).alias("k0"), short(path).alias("k1"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("k2"), F.xxhash64("html").alias("k3")
    )
    key = ["k0", "k1", "k2", "k3"]
    given = pages.sparkSession.sparkContext.broadcast(_borders(keyed.select(*key), block_rows))
    through = ["page_id", "url", "host", *key]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, borders = zstandard.ZstdCompressor(level=3), given.value
        firsts = [b[0] for b in borders]
        for b in batches:
            at, block, own, packed = [], [], [], []
            for i, (page, k) in enumerate(zip(b.column("html"), zip(*(b.column(c).to_pylist() for c in key), strict=True), strict=True)):
                data = z.compress(json.dumps(lines(page.as_py()), ensure_ascii=False).encode("utf-8", "surrogatepass"))
                mine = bisect_right(firsts, k)
                to = [mine]
                if mine and k <= borders[mine - 1][2]:
                    to.append(mine - 1)
                if mine < len(borders) and k >= borders[mine][1]:
                    to.append(mine + 1)
                for t in to:
                    at.append(i)
                    block.append(t)
                    own.append(t == mine)
                    packed.append(data)
            rows = b.select(through).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(block, pa.int64()), pa.array(own, pa.bool_()), pa.array(packed, pa.binary())], [*through, "block", "own", "lines"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        z = zstandard.ZstdDecompressor()
        kinds = [to_arrow_type(id_kind), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

        def runs():
            """(block, host, lines, rows that are the block's own) of each run of equal keys."""
            last, run = None, None
            for b in batches:
                for page_id, url, at, *k, block, own, packed in zip(*(b.column(c).to_pylist() for c in (*through, "block", "own", "lines")), strict=True):
                    if (block, *k) != last:
                        if run:
                            yield run
                        last, run = (block, *k), (block, at, json.loads(z.decompress(packed).decode("utf-8", "surrogatepass")), [])
                    if own:
                        run[3].append((page_id, url))
            if run:
                yield run

        def finished():
            """Rows of each run, once its neighbours on both sides are there."""
            window: deque = deque()  # runs from NEAR before the waiting ones on
            done = 0  # how many of the window are finished
            for run in _chained(runs()):
                if run is None or (window and run[:2] != window[-1][:2]):  # the group's end
                    while done < len(window):
                        yield from _result(window, done)
                        done += 1
                    window.clear()
                    done = 0
                if run is None:
                    break
                window.append(run)
                while len(window) - done > NEAR:
                    yield from _result(window, done)
                    done += 1
                while done > NEAR:
                    window.popleft()
                    done -= 1

        out: list[tuple] = []
        for row in finished():
            out.append(row)
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], OUT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], OUT)

    key_kinds = "k0 string, k1 string, k2 string, k3 long"
    cut = keyed.mapInArrow(parse, f"page_id {kind}, url string, host string, {key_kinds}, block long, own boolean, lines binary")
    dealt = cut.repartition("block").sortWithinPartitions("block", *key)
    return dealt.mapInArrow(pair, f"page_id {kind}, url string, text string, paired boolean, n_shared long, n_marked long, n_kept_shared long")


OUT = ["page_id", "url", "text", "paired", "n_shared", "n_marked", "n_kept_shared"]


def _chained(runs: Iterator[tuple]) -> Iterator[tuple | None]:
    yield from runs
    yield None


def _result(window: deque, at: int) -> Iterator[tuple]:
    """Output rows of the run at ``at``, against the runs of its host next to it in the window."""
    own = window[at]
    if not own[3]:
        return
    near = [window[i][2] for i in range(max(0, at - NEAR), min(len(window), at + NEAR + 1)) if i != at]
    text, *counts = extract(own[2], near)
    for page_id, url in own[3]:
        yield (page_id, url, text, bool(near), *counts)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS raw FROM a)
SELECT page_id, url, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM t
"""

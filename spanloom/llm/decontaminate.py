"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Text is normalised byte-wise (A-Z lower-cased, every other ASCII byte that is neither digit nor letter becomes a space), so
a word is a maximal run of digits, letters and non-ASCII characters. A window is ``WINDOW`` consecutive words of an item;
an item with fewer words, but not none, is one window. For the automaton each word of the benchmark becomes a code of a few
digits, as many for every word, and any other word a gap of that length; it scans each normalised text once, passing over
stretches between gaps that are shorter than any window. Hits are ranges of word numbers, mapped for the spans to code-point
offsets of the original text. No shuffle: the documents are only mapped.

The benchmark's size is measured before it is collected. Above ``AUTOMATON_WORDS`` words it is dealt into blocks by a hash of
the item, with one automaton and one scan per block. The documents' rows get a key of their own, and the blocks' hits are
united by it, so nothing is dropped, no two rows are mixed, and the driver never holds more than one block.

Defined cases: a null text has no words (n_words 0, not contaminated); a null or empty item has no window; equal windows of
several items count for all of them; repeated documents and null doc_ids each keep their row, with any number of blocks; the
windows of an item with a null item_id are hit like any others, but it has no name to list or count; an empty benchmark hits
nothing. Other columns may be present in either table and are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, row_keyed, table

WINDOW = 13
SHARE = 20
#: A word stands in up to ``WINDOW`` trie nodes for each of its three digits at most, of some 70 bytes: some 250 MB in a worker.
AUTOMATON_WORDS = 100_000
DIGITS = 64
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


class Automaton:
    """Windows of benchmark items; ``scan`` gives (first word, last word + 1, item numbers) of each occurrence."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        import ahocorasick

        by: dict[tuple[bytes, ...], list[str | None]] = defaultdict(list)
        for item, text in items:
            for w in windows(text, size):
                by[w].append(item)
        known = sorted({x for w in by for x in w})
        self.width = 1
        while DIGITS**self.width < len(known):
            self.width += 1
        # each place has digits of its own, so a match begins and ends with words, and few of them, so nodes have few children
        place = lambda i, k: chr(1 + DIGITS * k + i // DIGITS**k % DIGITS)
        self.codes = {x: "".join(place(i, k) for k in range(self.width)) for i, x in enumerate(known)}
        self.auto = ahocorasick.Automaton()
        for w, ids in by.items():
            self.auto.add_word("".join([self.codes[x] for x in w]), (len(w), tuple(ids)))
        self.empty = not by
        if by:
            self.auto.make_automaton()
            self.runs = re.compile(f"[^\0]{{{self.width * min(map(len, by))},}}")

    def scan(self, w: list[bytes]) -> list[tuple[int, int, tuple[str | None, ...]]]:
        if self.empty or not w:
            return []
        k = self.width
        text = "".join(map(self.codes.get, w, repeat("\0" * k)))
        out = []
        for run in self.runs.finditer(text):
            out += [(end // k + 1 - n, end // k + 1, ids) for end, (n, ids) in self.auto.iter(text, run.start(), run.end())]
        return out


_BUILT: dict = {}


def _automaton(given, size: int) -> Automaton:
    """One automaton per Python worker and block, kept between tasks."""
    if (given.value, size) != _BUILT.get("of"):
        _BUILT["of"], _BUILT["auto"] = (given.value, size), Automaton(given.value, size)
    return _BUILT["auto"]


def matched(hits: list[tuple[int, int, tuple[str | None, ...]]]) -> tuple[list[tuple[int, int]], set[str]]:
    """The hit words as disjoint ranges that do not touch, and the named items."""
    ranges: list[list[int]] = []
    items: set[str | None] = set()
    for a, b, ids in sorted(hits):
        items.update(ids)
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], b)
        else:
            ranges.append([a, b])
    return [(a, b) for a, b in ranges], items - {None}


def _items(benchmark: DataFrame, automaton_words: int) -> tuple[DataFrame, int]:
    """Items and the number of blocks that their measured size asks for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    # a word has two bytes at least with its separator, or is an item's last one
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0)).cast("long")).first()[0]
    return items, max(1, -(-total // automaton_words))


def _block(items: DataFrame, block: int, blocks: int):
    own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    return items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()])


def hit_table(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, ranges (hit words), items (sorted), spans (code points of the original) for each row."""
    items, blocks = _items(benchmark, automaton_words)
    docs = docs.select("doc_id", "text")
    if blocks > 1:
        return _hits(row_keyed(docs, "_row"), items, blocks, size, ["doc_id", "_row"]).drop("_row")
    return _hits(docs, items, blocks, size, ["doc_id"])


def _hits(docs: DataFrame, items: DataFrame, blocks: int, size: int, keys: list[str]) -> DataFrame:
    """``keys`` and the hits of each row; several blocks need a _row among them."""
    out = None
    for block in range(blocks):
        given = _block(items, block, blocks)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(given, size)  # noqa: B023
            for b in batches:
                cols: list[list] = [[], [], [], []]
                for text in b.column("text").to_pylist():
                    w = words(text)
                    ranges, ids = matched(auto.scan(w))
                    spans = []
                    if ranges:
                        at = [m.span() for m in WORD.finditer(text)]
                        spans = [{"start": at[x][0], "end": at[y - 1][1]} for x, y in ranges]
                    for c, v in zip(cols, (len(w), [{"first": x, "last": y} for x, y in ranges], sorted(ids), spans), strict=True):
                        c.append(v)
                pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k) for k in keys], pa.array(cols[0], pa.int64()), pa.array(cols[1], pair("first", "last")), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pair("start", "end"))],
                    [*keys, "n_words", "ranges", "items", "spans"],
                )

        kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
        one = docs.select(*keys, "text").mapInArrow(scan, f"{kinds}, n_words long, ranges array<struct<first:long,last:long>>, items array<string>, spans array<struct<start:long,end:long>>")
        out = one if out is None else out.unionByName(one)
    if blocks == 1:
        return out
    # blocks see the same rows; a row's doc_id and words are the same in each, and a block has one span for each range
    places = F.transform(F.arrays_zip("ranges", "spans"), lambda x: F.struct(x["ranges"]["first"].alias("first"), x["ranges"]["last"].alias("last"), x["spans"]["start"].alias("start"), x["spans"]["end"].alias("end")))
    merged = materialize(out, "decontamination-blocks").groupBy("_row").agg(
        *[F.first(k).alias(k) for k in keys if k != "_row"], F.max("n_words").alias("n_words"), F.flatten(F.collect_list(places)).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).withColumn("places", _union(F.array_sort("places")))
    pick = lambda a, b: F.transform("places", lambda x: F.struct(x[a].alias(a), x[b].alias(b)))
    return merged.select(*keys, "n_words", pick("first", "last").alias("ranges"), "items", pick("start", "end").alias("spans"))


def _union(places):
    """Sorted word ranges, with their spans, joined where the words touch or overlap, as ``matched`` does (JVM side)."""
    last = lambda acc: F.element_at(acc, -1)
    more = lambda acc, x, c: F.greatest(last(acc)[c], x[c]).alias(c)
    return F.aggregate(
        places, F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["last"] < x["first"]), F.concat(acc, F.array(x)))
        .otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["first"].alias("first"), more(acc, x, "last"), last(acc)["start"].alias("start"), more(acc, x, "end"))))),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    hits = hit_table(docs, benchmark, size)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    return hits.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark passage; no shuffle with one block.

    A row goes if ``size`` or more consecutive words of it are hit, which any whole window brings about however long the
    text is. Windows of shorter items, a word or two perhaps, count by their share of the text alone (``contaminated``).
    """
    items, blocks = _items(benchmark, automaton_words)
    if blocks > 1:
        rows = row_keyed(docs, "_row")
        hits = _hits(rows, items, blocks, size, ["_row"])
        n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
        passage = F.exists("ranges", lambda x: x["last"] - x["first"] >= size)
        bad = hits.where(passage | ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words")))).select("_row")
        return rows.join(bad, "_row", "left_anti").select(*docs.columns)
    given = _block(items, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(given, size)
        for b in batches:
            keep = []
            for v in b.column("text"):
                w = words(v.as_py())
                ranges, _ = matched(auto.scan(w))
                n = sum(y - x for x, y in ranges)
                keep.append(not n or (share * n < len(w) and all(y - x < size for x, y in ranges)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute(docs: list[tuple], items: list[tuple], size: int = WINDOW, share: int = SHARE) -> dict:
    """Window sets against window sets, for tests."""
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pat.findall((t or "").translate(low))
    out = {}
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for item, t in items:
            v = split(t)
            k = min(size, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if wins and tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    ids |= {str(item)} - {"None"}
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

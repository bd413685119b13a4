"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Its alphabet is a-z and the corpus's most frequent other letters,
``LETTERS`` in all, and one symbol stands for any letter beyond these. Suspicious pieces of a text (symbols or digits among
letters, letters repeated three times or more, single characters set apart by spaces or punctuation) become character lattices:
each character may be itself, a letter it imitates, or nothing, at a cost of the channel, and Viterbi decoding under the trigram
model restores the likeliest word. Repeats of one character beyond ``MOST_REPEATS`` decide nothing more and are one. Restored
words join the text's plain words. The patterns of suspicious pieces take linear time on any text.

The scorer is learned from labelled documents outside the held-out third: at most ``PER_CLASS`` of each class, chosen by a
hash of the doc_id, whose ids are broadcast, so no text is shuffled for the join with the labels. Texts of the sample that are
near copies count once. Features are whole words and word beginnings of ``STEMS`` letters, in restored text; those in at least
``SUPPORT`` of the toxic sample whose precision is clearly above the labels' rate are kept (so they number at most a text's
mean features divided by ``SUPPORT``, at any size), and a logistic regression weighs their presence, repetition and density.

Defined cases: a null text counts as empty and scores like any text without features; with no labels, or only one class, every
score is 0; null labels are not learned from; a doc_id with several labels counts for each; a null doc_id is in the learning
part; repeated rows each keep their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spanloom.llm.common import materialize, table

PER_CLASS = 10_000
STEMS = (3, 4, 5, 6, 7)
SUPPORT, LEAST_COUNT = 0.02, 4
LIFT = 2.5
Z = 1.96
STEPS, RIDGE = 500, 3e-5
FLUSH = 200_000
SKETCH = 4
THRESHOLD = 0.7
LETTERS = 62
N = LETTERS + 2  # the letters, a word's border, any other letter
OTHER = N - 1
MOST_REPEATS = 6
KNOWN, KNOWN_CHARS = 100_000, 64
#: Letters that a character imitates.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "ø": "o", "*": "aeiou", "#": "h"}
IMITATE, SKIP_REPEAT, SKIP_NOISE, SKIP_SYMBOL, SKIP_LETTER = 1.0, 0.5, 1.0, 10.0, 12.0
_SYMBOLS = "".join(LEET)
_SYM, _LETTER = re.escape(_SYMBOLS), r"[^\W\d_]"
_RUN = re.compile(rf"(?<!{_LETTER})(?<![{_SYM}]){_LETTER}*+[{_SYM}](?:{_LETTER}|[{_SYM}])*+")
_HAS_SYMBOL = re.compile(rf"[{_SYM}]")
_TAIL, _DIGITS = re.compile(r"[0-9@$]*"), re.compile(r"[0-9]*")
_TRIPLE = re.compile(rf"({_LETTER})\1\1")
_SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER}|[{_SYM}])(?:([ ._\-*~]{{1,2}})(?:{_LETTER}|[{_SYM}]))(?:\1(?:{_LETTER}|[{_SYM}]))+(?![^\W_])")
_LONG_REPEAT = re.compile(rf"(.)\1{{{MOST_REPEATS - 1}}}\1+", re.S)
_WORDS = re.compile(r"[^\W\d_]+")


def leet_pieces(low: str) -> Iterator[str]:
    """Runs of letters and imitating symbols with a symbol before their last letter or digits behind it, up to these."""
    for m in _RUN.finditer(low):
        body = m[0].rstrip(_SYMBOLS)
        if not body:
            continue
        tail = _TAIL if _HAS_SYMBOL.search(body) else _DIGITS
        rest = tail.match(m[0], len(body))[0]
        if rest or tail is _TAIL:
            yield body + rest


def _table(letters: str) -> np.ndarray:
    """Symbol of each code point: border 0, the letters from 1, any other letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = OTHER
    for i, x in enumerate(letters):
        out[ord(x)] = i + 1
    return out


def _codes(low: str, table: np.ndarray) -> np.ndarray:
    """Symbols of lower-cased text, one border for each run of anything but letters."""
    out = table[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    out = np.concatenate([[0], out, [0]])
    return out[(out != 0) | (np.concatenate([[1], out[:-1]]) != 0)]


def alphabet(docs: DataFrame) -> str:
    """a-z and the most frequent other letters of all documents, at most ``LETTERS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for v in b.column("text"):
                if (text := v.as_py()) and not text.isascii():
                    total.update(re.sub(r"[\x00-\x7f]+", "", text.lower()))
        own = [x for x in total if x.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([ord(x) for x in own], pa.int64()), pa.array([total[x] for x in own], pa.int64())], ["letter", "n"])

    found = docs.select("text").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(LETTERS - 26)
    return "abcdefghijklmnopqrstuvwxyz" + "".join(chr(r[0]) for r in found.collect())


def trigram_counts(docs: DataFrame, letters: str) -> np.ndarray:
    """Counts over the whole texts of all documents; (N, N, N)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(letters)
        total = np.zeros(N**3, np.int64)
        for b in batches:
            for v in b.column("text"):
                if text := v.as_py():
                    c = _codes(text.lower(), table)
                    if len(c) > 2:
                        np.add.at(total, (c[:-2] * N + c[1:-1]) * N + c[2:], 1)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["gram", "n"])

    out = np.zeros(N**3)
    for gram, n in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[gram] = n
    return out.reshape(N, N, N)


class Channel:
    """Viterbi decoding of suspicious pieces under a trigram model of ``letters``."""

    def __init__(self, counts: np.ndarray, letters: str):
        uni = counts.sum((0, 1)) + 1.0
        bi = counts.sum(0) + 5 * (uni / uni.sum())[None, :]
        bi /= bi.sum(1, keepdims=True)
        tri = counts + 5 * bi[None]
        self.log = np.log(tri / tri.sum(2, keepdims=True)).tolist()
        self.symbol = {x: i + 1 for i, x in enumerate(letters)}
        self.known: dict[str, str] = {}

    def restore(self, piece: str) -> str:
        piece = _LONG_REPEAT.sub(lambda m: m[1] * MOST_REPEATS, piece)
        if (out := self.known.get(piece)) is None:
            if len(self.known) > KNOWN:
                self.known = {}
            out = self._decode(piece)
            if len(piece) <= KNOWN_CHARS:
                self.known[piece] = out
        return out

    def _decode(self, piece: str) -> str:
        states = {(0, 0): (0.0, None)}  # last two symbols to (cost, chain of letters)
        log, before = self.log, ""
        for ch in piece:
            ways: list[tuple[int, str, float]] = []
            if ch.isalpha():
                ways.append((self.symbol.get(ch, OTHER), ch, 0.0))
            ways += [(self.symbol[x], x, IMITATE) for x in LEET.get(ch, "")]
            if ch == before:
                skip = SKIP_REPEAT
            elif ch in " ._-~":
                skip = 0.0
            elif ch.isalpha():
                skip = SKIP_LETTER
            else:
                skip = SKIP_SYMBOL if ch in LEET else SKIP_NOISE
            after: dict = {}
            for (a, b), (cost, chain) in states.items():
                for s, x, extra in ways:
                    new = cost + extra - log[a][b][s]
                    key = (b, s)
                    if key not in after or new < after[key][0]:
                        after[key] = (new, (x, chain))
                new = cost + skip
                if (a, b) not in after or new < after[a, b][0]:
                    after[a, b] = (new, chain)
            states, before = after, ch
        _, chain = min(((cost - log[a][b][0], chain) for (a, b), (cost, chain) in states.items()), key=lambda x: x[0])
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return "".join(out[::-1])

    def words(self, text: str | None) -> list[str]:
        """Plain and restored words, with repeats."""
        low = (text or "").lower()
        out = _WORDS.findall(low)
        restored = [self.restore(p) for p in leet_pieces(low)]
        if _TRIPLE.search(low):
            restored += [self.restore(w) for w in out if _TRIPLE.search(w)]
        out += [w for w in restored if w]
        for m in _SPACED.finditer(low):
            if word := self.restore(m[0]):
                out += [word, word[1:]]  # an article or pronoun may stand before spaced letters
        return out


def features(word: str) -> list[str]:
    """The word's beginnings, and the word itself behind a mark."""
    return [word[:k] for k in STEMS if len(word) > k] + [word + "$"]


class Scorer:
    """Logistic regression over three values of each selected feature: present, repeated, density."""

    def __init__(self, channel: Channel, chosen: list[str], weights: np.ndarray | None = None, bias: float = -np.inf):
        self.channel, self.bias = channel, bias
        self.at = {f: i for i, f in enumerate(chosen)}
        self.heads = {f[:3] for f in chosen} | {f[:-1][:3] for f in chosen if f.endswith("$")}
        self.weights = np.zeros(3 * len(chosen)) if weights is None else weights

    def values(self, words: list[str]) -> dict[int, float]:
        counts: Counter = Counter()
        for w, n in Counter([w for w in words if w[:3] in self.heads]).items():
            for f in features(w):
                if f in self.at:
                    counts[self.at[f]] += n
        out = {}
        for i, n in counts.items():
            out[3 * i] = 1.0
            if n > 1:
                out[3 * i + 1] = 1.0
            out[3 * i + 2] = min(1.0, 10 * n / (len(words) + 5))
        return out

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:  # nothing was learned
            return 0.0
        z = self.bias + sum(self.weights[i] * v for i, v in self.values(self.channel.words(text)).items())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def fit(self, rows: list[dict[int, float]], y: np.ndarray, weight: np.ndarray) -> None:
        """Adam on the weighted log loss with a ridge; ``rows`` are sparse."""
        n, d = len(rows), len(self.weights)
        at = np.repeat(np.arange(n), [len(r) for r in rows])
        col = np.fromiter((i for r in rows for i in r), np.int64, len(at))
        val = np.fromiter((v for r in rows for v in r.values()), float, len(at))
        weight = weight / weight.sum()
        theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
        theta[d] = math.log(max(1e-6, (weight * y).sum()) / max(1e-6, (weight * (1 - y)).sum()))
        for t in range(1, STEPS + 1):
            z = theta[d] + np.bincount(at, theta[col] * val, minlength=n)
            e = weight * (1 / (1 + np.exp(-z.clip(-50, 50))) - y)
            g = np.concatenate([np.bincount(col, e[at] * val, minlength=d) + RIDGE * theta[:d] / max(1, d) ** 0.5, [e.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.weights, self.bias = theta[:d], float(theta[d])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer:
    spark = docs.sparkSession
    letters = alphabet(docs)
    channel = Channel(trigram_counts(docs, letters), letters)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Scorer(channel, [])
    dice = F.xxhash64(F.col("doc_id"), F.lit(5))
    sample = None
    for c in totals:  # bounded by 2 * per_class rows
        rate = min(1.0, 1.2 * per_class / totals[c])
        own = known.where((F.col("toxic") == c) & (F.pmod(dice, F.lit(1 << 40)) < int(rate * (1 << 40)))).orderBy(dice, "doc_id").limit(per_class)
        sample = own if sample is None else sample.unionByName(own)
    given = spark.sparkContext.broadcast(channel)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [given.value.words(v.as_py()) for v in b.column("text")]
            keys = [",".join(sorted(f"{xxh64_intdigest(w.encode('utf-8', 'surrogatepass')):016x}" for w in set(bag))[:SKETCH]) for bag in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words, pa.list_(pa.string())), b.column("toxic")], ["key", "words", "toxic"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(n: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[1] for x in n.values()], pa.int64()), pa.array([x[0] for x in n.values()], pa.int64())], ["feature", "n1", "n0"])

        n: dict[str, list[int]] = {}
        for b in batches:
            for words, t in zip(b.column("words").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for f in {f for w in set(words) for f in features(w)} | {""}:  # the empty one counts the rows
                    n.setdefault(f, [0, 0])[t] += 1
                if len(n) > FLUSH:
                    yield flush(n)
                    n = {}
        yield flush(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.withColumn("doc_id", F.col("doc_id").cast(kind))), "doc_id")
    # copies and near copies share their least word hashes and count once, or a copied text's words would pass for toxic
    one = rows.select("text", "toxic").mapInArrow(bags, "key string, words array<string>, toxic int").groupBy("key", "toxic").agg(F.min("words").alias("words"))
    one = materialize(one.select("words", "toxic"), "toxicity-sample")
    counts = one.mapInArrow(counted, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = materialize(counts.where(f"n1 >= {LEAST_COUNT}"), "toxicity-features")
    n = counts.where("feature = ''").first()
    if not n or not n.n0:
        return Scorer(channel, [])
    w1, w0 = totals[1] / n.n1, totals[0] / n.n0  # the classes' shares in the labels, not in the sample
    prior = totals[1] / (totals[0] + totals[1])
    least = max(LEAST_COUNT, math.ceil(SUPPORT * n.n1))
    p, seen = F.col("n1") * w1 / (F.col("n1") * w1 + F.col("n0") * w0), F.col("n1") + F.col("n0")
    low = (p + Z * Z / 2 / seen - Z * F.sqrt((p * (1 - p) + Z * Z / 4 / seen) / seen)) / (1 + Z * Z / seen)
    good = counts.where((F.col("feature") != "") & (F.col("n1") >= least)).withColumn("low", low).where(F.col("low") > min(0.5, LIFT * prior))
    chosen = [r[0] for r in good.orderBy("feature").collect()]
    scorer = Scorer(channel, chosen)
    if not chosen:
        return scorer
    wanted = spark.sparkContext.broadcast(Scorer(None, chosen))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [wanted.value.values(x) for x in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x in v], pa.list_(pa.int32())), pa.array([list(x.values()) for x in v], pa.list_(pa.float32())), b.column("toxic")], ["at", "values", "toxic"])

    # at most the sample; equal rows are counted where they are made, so those without features are no hot group
    got = one.mapInArrow(valued, "at array<int>, values array<float>, toxic int").groupBy("toxic", "at", "values").count().collect()
    got = sorted((r.toxic, r.at, r["values"], r["count"]) for r in got)
    y, n = np.array([r[0] for r in got], float), np.array([r[3] for r in got], float)
    scorer.fit([dict(zip(r[1], r[2], strict=True)) for r in got], y, n * np.where(y == 1, w1, w0))
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of each text."""
    given = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([given.value.score(v.as_py()) for v in b.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns give the base spans. The method adds spans of kind ``markov``: maximal runs of ``RUN`` characters, less what base
spans cover, of at least ``MIN_RUN`` characters are scored by the mean log-likelihood ratio of two first-order character
models, one of random strings and one of ordinary identifiers.

The models are trained from labelled samples. ``fit`` labels runs of about ``SAMPLE_DOCS`` documents, chosen by a hash, by the
patterns: values of base spans are random strings, runs of ``MIN_WORD`` letters and joints or more that touch no base span are
ordinary. Their transitions are counted where the texts are, and mixed at equal weight at most with those of ``SAMPLES``
generated strings of each class, so that alphabets which a corpus lacks are known too. A quarter of the sample is held out: the
threshold is the least score that keeps false alarms on its ordinary runs, and on the generated ones, under ``FALSE_ALARMS``,
and never below zero; ``Ratio.report`` has the recall and the false alarms there.

Defined cases: a null text counts as empty and has no spans; repeated rows each keep their row; texts of any length are
scanned whole; a table without base spans, or an empty one, leaves the generated samples alone to train on; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 20
KINDS = ("assign", "access", "hex", "markov")
MIN_WORD = 8
WORDLIKE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]{{{MIN_WORD},}}+(?![0-9])")
SAMPLES = 4000
SAMPLE_DOCS = 50_000
STEP = 0.05
FALSE_ALARMS = 0.001
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts of ordinary identifiers.
PARTS = (
    "user name get set config value index list item data file path node tree error handler request response server client session manager "
    "service factory builder parser buffer stream reader writer count size length total page table column row field key map cache queue "
    "event message update create delete remove insert select filter group order sort time date start end first last next previous parent "
    "child window view model controller test module package version number string object array default option input output result status"
).split()
#: Syllables of ordinary words in several languages.
SYLLABLES = "the and ing tion ent her for ion ter est ers ati hat ate all eth hes ver his oft ith fth sto ein sch che ich der und lle ment que les des ien ado con ara era cion mente dad".split()


def random_string(r: random.Random) -> str:
    kind = r.choice([SYMBOLS[26:62], SYMBOLS[:62], SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[:62] + "_-", "0123456789ABCDEF", "0123456789abcdef"])
    return "".join(r.choices(kind, k=r.randint(MIN_RUN, 64)))


def ordinary_identifier(r: random.Random) -> str:
    out, style = "", r.randrange(7)
    while len(out) < MIN_RUN:
        w = r.choice(PARTS) if style < 5 else "".join(r.choices(SYLLABLES, k=r.randint(2, 4)))
        if style in (0, 5):
            out += w.capitalize()
        elif style == 1:
            out += ("_" if out else "") + w
        elif style == 2:
            out += ("-" if out else "") + w
        elif style == 3:
            out += ("/" if out else "") + w
        elif style == 4:
            out += ("_" if out else "") + w.upper()
        else:
            out += w
    if r.random() < 0.3:
        out += r.choice(["", "_", "-", "/"]) + str(r.randint(0, 2030))
    return out


N = len(SYMBOLS) + 1  # and the border of a run
_AT = np.zeros(256, np.int64)
_AT[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, N)


def transitions(runs: list[str]) -> np.ndarray:
    """Counts of (character before, character) in runs; (N, N), with the border before each run's first character."""
    c = np.concatenate([[0], _AT[np.frombuffer("\n".join(runs).encode("ascii"), np.uint8)]])
    pairs = (c[:-1] * N + c[1:])[c[1:] > 0]
    return np.bincount(pairs, minlength=N * N).reshape(N, N)


class Ratio:
    """Mean log-likelihood ratio per character of random against ordinary strings, from their transition counts."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray):
        log = lambda counts: np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
        self.ratio = log(random_counts) - log(ordinary_counts)
        self.threshold = 0.0
        self.report: dict[str, float] = {}

    def score(self, s: str) -> float:
        c = np.concatenate([[0], _AT[np.frombuffer(s.encode("ascii"), np.uint8)]])
        return float(self.ratio[c[:-1], c[1:]].mean())


@lru_cache(1)
def generated(seed: int = 1, samples: int = SAMPLES) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers."""
    r = random.Random(seed)
    return [random_string(r) for _ in range(samples)], [ordinary_identifier(r) for _ in range(samples)]


def _mixed(prior: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    return prior + corpus * min(1.0, prior.sum() / max(1, corpus.sum()))


def trained(random_counts: np.ndarray | None = None, ordinary_counts: np.ndarray | None = None) -> Ratio:
    """A model of the generated samples, mixed with counts of a corpus, whose threshold suits the generated samples."""
    strings, ordinary = generated()
    none = np.zeros((N, N), np.int64)
    model = Ratio(_mixed(transitions(strings), none if random_counts is None else random_counts), _mixed(transitions(ordinary), none if ordinary_counts is None else ordinary_counts))
    scores = sorted(model.score(s) for s in ordinary)
    model.threshold = max(0.0, scores[int(len(scores) * (1 - FALSE_ALARMS))])
    return model


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Values of base spans, and ordinary runs that touch none."""
    base = base_spans(text)
    values = [ASSIGN.match(text, a)[2] if k == "assign" else text[a:b] for a, b, k in base]
    values = [v.replace(".", "") for v in values]  # the models have no dot
    runs, ranges, i = [], _covered(base), 0
    for m in WORDLIKE.finditer(text):
        while ranges[i][1] <= m.start():
            i += 1
        if ranges[i][0] >= m.end():
            runs.append(m[0])
    return values, runs


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ratio:
    """A model of about ``sample_docs`` documents; counts and histograms of a fixed size reach the driver, no texts."""
    scale, n = 1 << 40, docs.count()
    rate = int(scale * min(1.0, sample_docs / max(1, n)))
    dice = lambda seed: F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(scale))
    sample = docs.where(F.col("text").isNotNull() & (dice(13) < rate)).select("text")
    held = dice(17) < scale // 4

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N, N), np.int64)
        for b in batches:
            for v in b.column("text"):
                for k, runs in enumerate(labelled(v.as_py())):
                    if runs:
                        total[k] += transitions(runs)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total.ravel()[own])], ["cell", "n"])

    counts = np.zeros(2 * N * N)
    for cell, k in sample.where(~held).mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[cell] = k
    model = trained(*counts.reshape(2, N, N))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for b in batches:
            for v in b.column("text"):
                for k, runs in enumerate(labelled(v.as_py())):
                    for r in runs:
                        if len(r) >= MIN_RUN:
                            at = (k, int(model.score(r) // STEP))
                            found[at] = found.get(at, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["ordinary", "step", "n"])

    steps = sample.where(held).mapInArrow(scored, "ordinary long, step long, n long").groupBy("ordinary", "step").agg(F.sum("n").alias("n")).collect()
    plain, secret = ({r.step: r.n for r in steps if r.ordinary == k} for k in (1, 0))
    above = lambda hist, at: sum(n for s, n in hist.items() if (s + 1) * STEP > at) / max(1, sum(hist.values()))
    for s in sorted(plain):  # each step ends a candidate
        if above(plain, model.threshold) <= FALSE_ALARMS:
            break
        model.threshold = max(model.threshold, (s + 1) * STEP)
    model.report = {"recall": above(secret, model.threshold + STEP), "false_alarms": above(plain, model.threshold), "secrets": sum(secret.values()), "ordinary": sum(plain.values())}
    return model


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # a run this long has no shorter one within it, so this equals dropping short matches of HEX
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _covered(base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Base spans (sorted by start) as disjoint ranges, and one beyond any text."""
    out: list[tuple[int, int]] = []
    for a, b, _ in base:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return [*out, (1 << 62, 1 << 62)]


def method_spans(text: str, base: list[tuple[int, int, str]], model: Ratio) -> list[tuple[int, int, str]]:
    """Spans of kind markov among the parts of runs that no base span covers."""
    out, ranges, i = [], _covered(base), 0
    for m in RUN.finditer(text):
        at = m.start()
        while ranges[i][1] <= at:
            i += 1
        j, parts = i, []
        while ranges[j][0] < m.end():  # a range is met by one run, or ends within the next
            parts.append((at, ranges[j][0]))
            at = ranges[j][1]
            j += 1
        parts.append((at, m.end()))
        i = max(i, j - 1)
        out += [(a, b, "markov") for a, b in parts if b - a >= MIN_RUN and model.score(text[a:b]) > model.threshold]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, model: Ratio | None = None) -> DataFrame:
    """doc_id and the spans (kind, start, end; code points, end exclusive) of each text; by generated samples alone without ``model``."""
    given = docs.sparkSession.sparkContext.broadcast(model or trained())  # two matrices of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for v in b.column("text"):
                text = v.as_py() or ""
                base = base_spans(text)
                kinds = [k for *_, k in base]
                every = base + method_spans(text, base, model)
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every),
                       [{"kind": k, "start": a, "end": e} for a, e, k in sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))])
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).drop("found")

"""Language ID by hierarchical discrimination.

A text becomes hashed counts of its letter 1-, 2- and 3-grams (runs of other characters count as one word boundary). The
language family is predicted first; linear support vector machines, one per pair of languages, then separate the family's
languages by votes. Families come from a fixed table, a language outside it is a family of its own. The machines are fitted
by dual coordinate descent on the driver over a bounded sample: about ``PER_LANG`` labelled documents of each language,
chosen by a hash of their ids, each with ``FRAGMENTS`` short pieces so that short texts are met in training too. Prediction
reads only the text, and reads it whole.

Defined cases: a text that is null or has no letter gives ``und`` with score 0, as does every text if nothing could be
learned; rows with null lang are not learned from but predicted; a null doc_id is in the learning part; one language alone
is always predicted, with score 1; repeated rows each keep their row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

PER_LANG = 300
FRAGMENTS = (3, 8, 25)
DIM = 4096
BLOCK = 1 << 18
SLOPE = 3.0
UND = "und"
#: Families of ISO 639-1 languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "celtic": "ga gd cy br", "uralic": "fi et hu", "turkic": "tr az kk uz", "semitic": "ar he mt am", "indic": "hi bn ur pa mr gu ne",
    "iranian": "fa ku ps tg", "dravidian": "ta te kn ml", "austronesian": "id ms tl jv mg",
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to itself for letters, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    own = [i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]
    out[own] = own
    return out


def grams(text: str | None) -> np.ndarray | None:
    """L2-normalised square roots of hashed n-gram counts; None without letters."""
    low = (text or "").lower()
    counts, any_letter = np.zeros(DIM, np.int64), False
    for i in range(0, len(low), BLOCK):  # blocks overlap by what an n-gram needs
        c = _letters()[np.frombuffer(low[max(0, i - 2) : i + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not c.any():
            continue
        any_letter = True
        c = np.concatenate([[0], c, [0]]).astype(np.uint32)
        c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for h in (one[c != 0], two, three):
            counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1), minlength=DIM)
    if not any_letter:
        return None
    x = np.sqrt(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss (a bias is the last weight), by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / q[i], 0.0)
            w += (new - alpha[i]) * y[i] * x[i]
            worst, alpha[i] = max(worst, abs(g)), new
        if worst < 1e-2:
            break
    return w.astype(np.float32)


class OneVersusOne:
    """Classes told apart by pairwise machines: most votes, then the larger sum of margins, then the first name."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights
        self.pairs = list(combinations(range(len(names)), 2))

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> OneVersusOne:
        names, labels = sorted(set(labels)), np.array(labels)
        rows = []
        for a, b in combinations(names, 2):
            own = (labels == a) | (labels == b)
            rows.append(fit_svm(x[own], np.where(labels[own] == a, 1.0, -1.0)))
        return cls(names, np.array(rows, np.float32).reshape(len(rows), DIM + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and scores."""
        n, k = len(x), len(self.names)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, total = np.zeros((n, k)), np.zeros((n, k))
        for j, (a, b) in enumerate(self.pairs):
            m = margin[:, j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            total[:, a] += np.tanh(m)
            total[:, b] -= np.tanh(m)
        best = (votes + (total + k) / (4 * k)).argmax(1)
        least = np.full(n, np.inf)  # the winner's least margin
        for j, (a, b) in enumerate(self.pairs):
            least = np.where(best == a, np.minimum(least, margin[:, j]), np.where(best == b, np.minimum(least, -margin[:, j]), least))
        return best, 1 / (1 + np.exp(-SLOPE * least.clip(-20, 20)))


class Hierarchy:
    def __init__(self, x: np.ndarray, labels: list[str]):
        kin = [family(v) for v in labels]
        self.top = OneVersusOne.fit(x, kin)
        self.within = {}
        for f in self.top.names:
            own = [i for i, k in enumerate(kin) if k == f]
            self.within[f] = OneVersusOne.fit(x[own], [labels[i] for i in own])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [(i, g) for i, t in enumerate(texts) if (g := grams(t)) is not None]
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if not found:
            return langs, scores
        at, x = np.array([i for i, _ in found]), np.array([g for _, g in found])
        top, sure = self.top.predict(x)
        for j, f in enumerate(self.top.names):
            own = np.flatnonzero(top == j)
            if len(own):
                inner = self.within[f]
                best, p = inner.predict(x[own])
                for i, b, s in zip(at[own], best, p * sure[own], strict=True):
                    langs[i], scores[i] = inner.names[b], float(s)
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Hierarchy | None:
    """A model of at most 2 * ``per_lang`` labelled documents a language, on average ``per_lang``."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    scale = 1 << 40
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(scale * min(1.0, per_lang / n)))])
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(scale))
    chosen = rows.where(dice < F.element_at(rate, F.col("lang"))).select("lang", "text", dice.alias("dice"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, dice, out = [], [], []
            for lang, text, d in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("dice").to_pylist(), strict=True):
                w = text.split()
                at = d % max(1, len(w))
                for t in (text, *(" ".join(w[at : at + n]) for n in FRAGMENTS)):
                    if (g := grams(t)) is not None:
                        langs.append(lang)
                        dice.append(d)
                        out.append(g.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(dice, pa.int64()), pa.array(out, pa.binary())], ["lang", "dice", "x"])

    bound = 2 * per_lang * (1 + len(FRAGMENTS)) * len(counts)
    got = chosen.mapInArrow(featured, "lang string, dice long, x binary").orderBy("dice", "x").limit(bound).collect()
    if not got:
        return None
    return Hierarchy(np.array([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), [r.lang for r in got])


def identify(docs: DataFrame, model: Hierarchy | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and score behind its columns, under ``names``; columns of these names are replaced."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                langs, scores = given.value.predict(texts) if given.value else ([UND] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, *names])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)(list(schema.fields)).add(names[0], "string").add(names[1], "double"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

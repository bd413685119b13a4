"""Tokenizer round trips, language ID and toxicity by held-out accuracy, and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import language_id as L
from spanloom.llm import sentencepieces as P
from spanloom.llm import toxicity as T

TEXTS = [None, "", " ", "  ", "Hello  world\n é", " a b  ", "\t\tx", "日本語 テキスト 🙂", "\u00a0\u2003", "a" * 5000, "word " * 3000, "x\x00y", "1234567 89", "<s> </s> <unk> <0x41>", "ﬁ ½", "e\u0301"]


@pytest.fixture(scope="module")
def codec():
    return P.Codec(open(P.MODEL, "rb").read())


def test_parse_agrees_with_the_library(codec):
    peer, m = codec.peer, codec.model
    assert len(m.pieces) == peer.vocab_size() and m.byte_fallback and m.kind == P.BPE
    assert all(m.pieces[i][0] == peer.id_to_piece(i) and abs(m.pieces[i][1] - peer.get_score(i)) < 1e-3 for i in range(0, len(m.pieces), 37))


def mixed_texts():
    r = random.Random(1)
    return TEXTS + ["".join(r.choice(" \tabcdeéß.,!日🙂0123") for _ in range(r.randrange(200))) for _ in range(200)] + [" " * k + "the end" + " " * k for k in range(1, 70)]


def test_backend_agrees_with_the_library(codec):
    """The rebuilt tokenizer alone, whole texts at a time, against SentencePiece: ids and decoded texts."""
    texts = [t or "" for t in mixed_texts()]
    got = [e.ids for e in codec.full.encode_batch(texts, add_special_tokens=False)]
    got = [g if t else [] for g, t in zip(got, texts, strict=True)]
    assert got == codec.peer.encode(texts)
    assert codec.decode(got) == texts


def test_chunks_give_the_backends_ids(codec):
    texts = mixed_texts()
    ids, odd, back = codec.code(texts)
    assert [i.tolist() for i in ids] == [e.ids if t else [] for t, e in zip(texts, codec.full.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)]
    assert not any(odd) and back == [t or "" for t in texts]


def test_ids_come_from_the_backend_and_the_library_only_where_they_differ():
    c = P.Codec(open(P.MODEL, "rb").read())
    texts, peer = ["one two one", "three", " two  "], c.peer

    class Wrong:  # disagrees on one chunk
        piece_to_id = staticmethod(peer.piece_to_id)

        @staticmethod
        def encode(chunks, num_threads=1):
            return [[5, 6] if x == "two" else w for x, w in zip(chunks, peer.encode(chunks), strict=True)]

    c.peer = Wrong
    ids, odd, back = c.code(texts)
    one = [e.ids for e in c.full.encode_batch(texts, add_special_tokens=False)]
    assert odd == [1, 0, 0] and ids[0].tolist() == [one[0][0], 5, 6, one[0][-1]] and ids[1].tolist() == one[1] and ids[2].tolist() == one[2]
    assert back[1:] == texts[1:] and back[0] == c.decode([ids[0].tolist()])[0] != texts[0]


def _model_bytes(kind, pieces, fallback=False, collapse=False):
    def field(n, payload):
        def varint(x):
            out = b""
            while x > 127:
                out += bytes([x & 127 | 128])
                x >>= 7
            return out + bytes([x])

        return bytes([*varint(n << 3 | (0 if isinstance(payload, int) else 2))]) + (varint(payload) if isinstance(payload, int) else varint(len(payload)) + payload)

    import struct

    out = b""
    for p, s, t in pieces:
        out += field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + field(3, t))
    return out + field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(3, 1) + field(4, int(collapse)) + field(5, 1))


def test_unigram_model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -3.0, 1), ("▁ab", -2.8, 1), ("bb", -3.2, 1)]
    for collapse in (False, True):
        c = P.Codec(_model_bytes(P.UNIGRAM, pieces, collapse=collapse))
        texts = ["ab", "abb ab", "b a bb", "aabab b", ""]
        ids, odd, back = c.code(texts)
        assert [i.tolist() for i in ids] == c.peer.encode(texts) and not any(odd) and back == texts


def test_spark_round_trip(spark, codec):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    enc = P.encode(df)
    got = {r.doc_id: r.text for r in P.decode(enc).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(r.round_trip and r.n_tokens == len(codec.peer.encode(TEXTS[r.doc_id] or "")) for r in P.summary(df).collect())
    assert P.encode(df.limit(0)).count() == 0
    again = P.summary(df.unionByName(df).withColumn("n_odd", F.lit("clash"))).collect()  # each repeated row keeps its row
    assert len(again) == 2 * len(TEXTS) and len({tuple(r) for r in again}) == len(TEXTS) and not any(r.n_odd for r in again)


SAMPLE = {"en": "the and with house from that was night", "de": "der und mit haus von dass war nacht schön", "fr": "le et avec maison depuis que était nuit été", "es": "el y con casa desde que era noche año"}


def language_rows(n):
    r = random.Random(8)
    return [(i, " ".join(r.choice(SAMPLE[k].split()) for _ in range(r.randint(6, 60))), k) for i in range(n) for k in [r.choice(list(SAMPLE))]]


def test_language_id_held_out(spark):
    rows = language_rows(800)
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "der und mit", None)], "doc_id long, text string, lang string")
    m = L.fit(df, per_lang=60)
    got = {r.doc_id: r for r in L.identify(df, m).withColumn("held", L.held_out(F.col("doc_id"))).collect()}
    held = [r for r in got.values() if r.held and r.doc_id < 1000]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(df.limit(0), m).count() == 0
    odd = spark.createDataFrame([(7, "der und mit haus", "x"), (7, "der und mit haus", "x"), (8, chr(0x30000) * 3, "x"), (None, "the house " * 50_000, "x")], "doc_id long, text string, lang_pred string")
    named = L.identify(odd, m).collect()
    assert [(r.doc_id, r.lang_pred) for r in named if r.doc_id != 8] == [(7, "de"), (7, "de"), (None, "en")]
    assert [r.lang_pred for r in named if r.doc_id == 8] != ["und"]  # a letter of a later plane is a letter
    assert {r.lang_pred for r in L.identify(df, L.fit(df.limit(0))).collect()} == {"und"}


def test_grams_see_whole_text(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 50)
    a = L.grams("abcdefghij" * 20)
    monkeypatch.setattr(L, "BLOCK", 1 << 18)
    assert np.dot(a, L.grams("abcdefghij" * 20)) > 0.98


def toxic_rows(n):
    r = random.Random(12)
    syll = "ka lo mi ne ru ta so ve pi du".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        w = [word() for _ in range(r.randint(20, 60))]
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "zzkrax" + r.choice(syll)]))
        docs.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = toxic_rows(1500)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return T.fit(d, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")), d, dict(labels)


def test_toxicity_held_out(spark, scorer):
    s, d, labels = scorer
    rows = T.score(d, s).withColumn("held", T.held_out(F.col("doc_id"))).collect()
    held = [(r.score >= T.THRESHOLD, labels[r.doc_id]) for r in rows if r.held and r.doc_id in labels]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and len(held) > 300


def test_suspicious_pieces_are_those_of_the_plain_patterns():
    """The linear scan against the same definition as one backtracking pattern."""
    import re

    sym = re.escape("".join(T.LEET))
    plain = re.compile(rf"(?<![^\W_])(?=[{sym}]*[a-z])[a-z{sym}]*[{sym}][a-z{sym}]*[a-z][0-9@$]*|(?<![^\W_])[a-z]+[0-9][a-z0-9]*")
    r = random.Random(5)
    for _ in range(3000):
        low = "".join(r.choice("ab1@! !.,$9") for _ in range(r.randrange(12)))
        assert list(T.leet_pieces(low)) == plain.findall(low), low


@pytest.mark.parametrize("unit", ["!", "!1", "a!", "ab", "a ", "a. ", "1", "* ", "é", "日本", "aab", "! ! "])
def test_long_runs_take_linear_time(scorer, unit):
    import time

    began = time.perf_counter()
    scorer[0].channel.words(unit * (60_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_restores_letters_beyond_a_to_z(spark):
    """Spaced, stretched and leetspeak words whose letters a-z lacks, in a corpus that has these letters."""
    words = ["déchet", "garçon", "größe", "дурак", "слово", "человек", "maison", "haus"]
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    letters = T.alphabet(d)
    assert set("éçößдурак") <= set(letters) and len(letters) <= T.LETTERS
    c = T.Channel(T.trigram_counts(d, letters), letters)
    for text, word in [("d é c h e t", "déchet"), ("дуууурак", "дурак"), ("д-у-р-а-к", "дурак"), ("g@rçon", "garçon"), ("größßßßße", "größe")]:
        assert word in c.words(text), text


@pytest.mark.parametrize("text", ["you 1d10t there", "an i d i o t here", "such a m0r0n", "what an idiiiiot", "M-O-R-O-N", "m@r@n no idi0t"])
def test_restores_obfuscation(scorer, text):
    assert {"idiot", "moron"} & set(scorer[0].channel.words(text))
    assert scorer[0].score("kalo mine rutave " + text) > scorer[0].score("kalo mine rutave") + 0.3


def test_toxicity_edges(spark, scorer):
    s, d, _ = scorer
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 50_000), (None, "moron")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in T.score(odd, s).collect()}
    assert got[1] == got[2] < 0.5 < got[3] and all(0 <= v <= 1 for v in got.values())
    assert T.score(odd.limit(0), s).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.score(empty, T.fit(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))).count() == 0
    none = T.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in T.score(odd, none).collect()} == {0.0}

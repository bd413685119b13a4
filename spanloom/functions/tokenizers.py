"""Tokenizers as picklable objects: ``encode(bytes) -> ids`` and, where known, ``decode(ids) -> bytes``."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit


class Tokenizer(Protocol):
    def encode(self, raw: bytes) -> list[int]: ...
    def decode(self, ids: list[int]) -> bytes: ...


def parts_of(tok: Tokenizer, ids: list[int]) -> list[bytes]:
    """The bytes of each id: the tokenizer's own ``parts`` where it has them, else one ``decode`` per id."""
    own = getattr(tok, "parts", None)
    return own(ids) if own else [tok.decode([i]) for i in ids]


def piece_id(raw: bytes) -> int:
    """Like ``views.id_of``."""
    return int.from_bytes(hashlib.sha256(raw).digest()[:4], "big") & 0x7FFFFFFF


class Ids(list):
    """Token ids with their ``parts`` (bytes) beside them, for tokenizers whose ids do not tell pieces apart; slices and sums keep them."""

    def __init__(self, ids, parts: list[bytes]):
        super().__init__(ids)
        self.parts = parts

    def __reduce__(self):
        return Ids, (list(self), self.parts)

    def __getitem__(self, i):
        own = super().__getitem__(i)
        return Ids(own, self.parts[i]) if isinstance(i, slice) else own

    def __add__(self, other):
        both = super().__add__(other)
        return Ids(both, self.parts + getattr(other, "parts", [])) if isinstance(other, Ids) or not other else both


#: A regular tokenizer keeps what it has seen up to these bounds, then starts anew.
KNOWN_PIECES, KNOWN_BYTES = 100_000, 16 << 20


@dataclass
class RegexTokenizer:
    """Pieces of a view; ids are hashes, so several pieces may share one, and ``encode`` gives ``Ids`` that keep their bytes.

    Of plain ids ``decode`` knows only those of the texts encoded last; of pieces that share an id, the last one.
    """

    pattern: str
    seen: dict[int, bytes] = field(default_factory=dict)
    known: dict[str, tuple[int, bytes]] = field(default_factory=dict)
    held: int = 0

    def encode(self, raw: bytes) -> Ids:
        found = re.findall(self.pattern, raw.decode("utf-8"))  # a window that is no UTF-8 is an error, never repaired
        if len(self.known) > KNOWN_PIECES or self.held > KNOWN_BYTES:
            self.seen, self.known, self.held = {}, {}, 0
        for p in set(found).difference(self.known):
            b = p.encode("utf-8")
            self.known[p] = piece_id(b), b
            self.held += len(b)
        got = list(map(self.known.__getitem__, found))
        out = Ids([i for i, _ in got], [b for _, b in got])
        self.seen.update(got)
        return out

    def parts(self, ids: list[int]) -> list[bytes]:
        return ids.parts if isinstance(ids, Ids) else list(map(self.seen.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.parts(ids))


class GreedyTokenizer:
    """Longest match over a vocabulary given as (id, bytes) pairs.

    A choice looks at most as far ahead as the longest piece, so an append can change only tokens that start in the last
    ``horizon`` bytes of the prefix.
    """

    def __init__(self, vocab: list[tuple[int, bytes]]):
        from spanloom.operators.segment import Pieces

        self.pieces = Pieces(vocab)
        self.bytes = dict(vocab)
        self.horizon = max((len(b) for _, b in vocab), default=1) - 1

    def encode(self, raw: bytes) -> list[int]:
        packed, at = self.pieces.packed(raw)
        if packed is None:
            raise ValueError(f"no token at byte offset {at}")
        return memoryview(packed).cast("q").tolist()

    def parts(self, ids: list[int]) -> list[bytes]:
        return list(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.parts(ids))


@dataclass
class HttpTokenizer:
    """A tokenizer server: POST /tokenize and /detokenize with JSON bodies; one connection per call, plain http only."""

    server: str
    timeout: float = 30.0

    def _post(self, path: str, body: dict) -> dict:
        parts = urlsplit(self.server)
        if parts.scheme != "http" or not parts.hostname or parts.path not in ("", "/"):
            raise ValueError(f"expected http://host:port, got {self.server}")
        request = urllib.request.Request(self.server.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", "Connection": "close"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            if answer.status not in (200, 201):
                raise ValueError(f"{path}: status {answer.status}")
            return json.load(answer)

    def encode(self, raw: bytes) -> list[int]:
        got = self._post("/tokenize", {"content": raw.decode("utf-8"), "add_special": False})
        ids = got.get("tokens", got.get("ids"))
        if not isinstance(ids, list) or not all(isinstance(i, int) and not isinstance(i, bool) and 0 <= i < 1 << 32 for i in ids):
            raise ValueError("the answer has no array of 32-bit token ids")
        return ids

    def decode(self, ids: list[int]) -> bytes:
        got = self._post("/detokenize", {"tokens": ids, "special": False})
        text = got.get("content", got.get("text"))
        if not isinstance(text, str):
            raise ValueError("the answer has no text")
        return text.encode("utf-8")


class RankedTokenizer:
    """Byte-pair ranks from a file of ``base64 rank`` lines, encoded by tiktoken (an optional dependency)."""

    def __init__(self, path: str, pattern: str, name: str = "ranked"):
        self.path, self.pattern, self.name, self._own = path, pattern, name, None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    @property
    def own(self):
        if self._own is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            self._own = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._own

    def encode(self, raw: bytes) -> list[int]:
        return self.own.encode_ordinary(raw.decode("utf-8"))

    def parts(self, ids: list[int]) -> list[bytes]:
        return self.own.decode_tokens_bytes(ids)

    def decode(self, ids: list[int]) -> bytes:
        return self.own.decode_bytes(ids)

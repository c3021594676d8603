"""Byte-level BPE encoding and decoding.

A piece of text is encoded without replaying merges: pyahocorasick (over the bytes
mapped to Latin-1) finds the longest token at every position; tokens are taken from
the left, longest first, as long as the pair with the previous token is one that
merging could leave side by side; else the search backtracks, never trying a position
twice.  Whether two tokens may stand together is decided by undoing their last merges
and is memoised.  The ids equal those of merging by rank.

Defined results: null text encodes as the empty text (no ids); an empty table gives
no rows; texts of any length are encoded whole; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: White space as the rank files' own library sees it (the Unicode property), spelt out.
SPACE = r"\t-\r \x85\xa0  -     　"
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces (no longer than CACHED_LENGTH) and pairs of tokens that a worker remembers in one generation; of two generations the older goes when the younger is full, so what is in use stays.
CACHED_PIECES, CACHED_LENGTH, PAIR_MEMO = 100_000, 40, 150_000


def explicit_space(pattern: str) -> str:
    """The splitting pattern with its white-space classes spelt out, so that both regex libraries agree."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(explicit_space(pattern))
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.lengths = [len(x) for x in self.bytes]
        self.texts = [str(i) for i in range(size)]
        self.halves = [self._halves(self.bytes[i], i) for i in range(size)]
        self.pairs = {h: i for i, h in enumerate(self.halves) if h[0] != i}
        self.shorter: dict[int, int] = {}
        self.memo: dict[int, bool] = {}
        self.old_memo: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old_cache: dict[str, tuple[int, ...]] = {}
        self.find = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a token that no merge makes is its own halves."""
        if len(token) < 2:
            return rank, rank
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if self.ranks.get(joined, 1 << 60) >= rank:
                return rank, rank
            parts[best : best + 2] = [joined]
        if len(parts) != 2 or parts[0] not in self.ranks or parts[1] not in self.ranks:
            return rank, rank
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging can leave a and b side by side: undo the later merge of the two until a pair would have merged sooner, or both are single."""
        key = a << 32 | b
        known = self.memo.get(key)
        if known is not None:
            return known
        halves, pairs, limit, answer = self.halves, self.pairs, 1 << 60, self.old_memo.get(key)
        left, right = a, b
        while answer is None:
            made = pairs.get((left, right))
            if made is not None and made < limit:
                answer = False
            elif left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        answer = True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        answer = True
        if len(self.memo) >= PAIR_MEMO:
            self.old_memo, self.memo = self.memo, {}
        self.memo[key] = answer
        return answer

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.shorter.get(token)
        if known is None:
            data = self.bytes[token]
            known = self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, lengths, compatible = len(data), self.lengths, self.compatible
        longest = [-1] * (n + 1)
        for end, token in self.find.iter(data.decode("latin-1")):
            longest[end - lengths[token] + 1] = token  # ends rise, so the longest stays
        # most pieces need no second try: take the longest token each time, as long as the memo allows each pair
        out: list[int] = []
        at, left, known = 0, -1, self.memo.get
        while at < n:
            token = longest[at]
            if left >= 0 and not known(left << 32 | token):
                break
            out.append(token)
            left = token
            at += lengths[token]
        else:
            return out
        out = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n or out == []:
            end = at + lengths[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at]
                if at == n:
                    break
                continue
            less = self._shorter(token)
            if less >= 0:
                token = less
                continue
            if not out:
                raise ValueError("the vocabulary can't encode these bytes")
            dead[at] = 1
            token = out.pop()
            at -= lengths[token]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache, known = self.cache, self.cache.get
        for piece in self.split.findall(text):
            ids = known(piece)
            if ids is None:
                ids = self.old_cache.get(piece)
                if ids is None:
                    ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_PIECES:
                        self.old_cache = cache
                        cache = self.cache = {}
                        known = cache.get
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(load_ranks(data), pattern)


def read_vocabulary(path: str) -> bytes:
    """The rank file's bytes, which go to the workers; their size is fixed by the vocabulary and checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """key and ids (array<int>) of every text."""
    return _run(df, key, text, vocabulary, pattern, "ids array<int>", lambda ids, _: ids, pa.list_(pa.int32()), "ids")


def decode(df: DataFrame, key: str, ids: str, vocabulary: str, pattern: str) -> DataFrame:
    """key and data (binary) of every id list; an id outside the vocabulary fails the job, null gives null."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else c.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], [key, "data"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, data binary")


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text, and ids if asked for: encoded, then decoded from the ids, without leaving the worker."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        c = codec(shared.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_sha, decoded_sha, kept = [], [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(sha(" ".join(map(c.texts.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(sha(c.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(array("i", ids))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(x.tobytes() for x in kept), np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _run(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str, schema: str, value, kind, name: str) -> DataFrame:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([value(c.encode(x.as_py() or ""), c) for x in batch.column(1)], kind)], [key, name])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {schema}")

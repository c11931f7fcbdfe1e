"""Encoding of texts with a public byte-level BPE vocabulary, and decoding.

A text is cut by the vocabulary's pattern into pieces, and every piece is encoded on its own. Within a piece
an Aho-Corasick automaton over all tokens gives the longest token at each byte. A backtracking search goes
through the piece with these: a token is taken if merging could have left it beside the one before (their
pair is compatible), else a shorter one is tried, else the last one is taken back. Exactly one sequence of
tokens is compatible throughout, and it is the one that merging pairs in order of rank gives, so the result
is exact; each byte position is refuted at most once, so the time is linear in the piece.

Null and empty texts have the empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pattern that cuts texts for the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a vocabulary file that the driver reads and broadcasts.
MAX_BYTES = 64_000_000
#: Pieces a worker remembers, and the longest it remembers.
CACHE, CACHE_BYTES = 400_000, 48


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by id."""
    with open(path, "rb") as f:
        raw = f.read(MAX_BYTES + 1)
    if len(raw) > MAX_BYTES:
        raise ValueError("the vocabulary is larger than MAX_BYTES")
    pairs = [line.split() for line in raw.splitlines() if line]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Codec:
    """The tables of one vocabulary. ``left`` and ``right``: the pair each token was merged from (itself if none)."""

    def __init__(self, tokens: Sequence[bytes], left: np.ndarray | None = None, right: np.ndarray | None = None):
        import ahocorasick
        import regex

        self.tokens = list(tokens)
        self.of = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) for t in self.tokens]
        self.cut = regex.compile(PATTERN).findall
        self.pair: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        if left is None:
            self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
            self._split()
        else:
            self.left, self.right = left.tolist(), right.tolist()
            self.pair = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.auto.add_word(t.decode("latin-1"), (i, len(t)))
        self.auto.make_automaton()
        # The next shorter token that starts a token, or -1.
        self.shorter = [next((self.of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.of), -1) for t in self.tokens]
        # Offset table: token i is blob[offset[i]:offset[i+1]].
        self.blob = b"".join(self.tokens)
        self.offset = np.concatenate(([0], np.cumsum(self.sizes)))

    def _split(self) -> None:
        """The merge that makes each token: the last pair left when its bytes are merged by lower ranks only."""
        for i, t in enumerate(self.tokens):
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                ranks = [self.of.get(parts[k] + parts[k + 1], i) for k in range(len(parts) - 1)]
                best = min(ranks)
                if best >= i:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                a, b = self.of[parts[0]], self.of[parts[1]]
                self.left[i], self.right[i] = a, b
                self.pair[a, b] = i

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a beside b: no merge across their border comes before the ones that made them.

        The border is followed back in time: of the two tokens at it the younger is undone, and at every step
        the pair at the border must not merge earlier than the token that was undone last.
        """
        pair, left, right = self.pair.get, self.left, self.right
        limit = len(left)
        while True:
            merged = pair((a, b))
            if merged is not None and merged < limit:
                return False
            cut_a, cut_b = right[a] != a, left[b] != b
            if cut_a and (a > b or not cut_b):
                limit, a = a, right[a]
            elif cut_b:
                limit, b = b + 1, left[b]
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.of.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest, size = [0] * n, [0] * n
        for end, (token, length) in self.auto.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                longest[start], size[start] = token, length
        out: list[int] = []
        open_at = [True] * (n + 1)
        size_of, shorter, ok = self.sizes, self.shorter, self.compatible
        at, token = 0, longest[0]
        while at < n:
            end = at + size_of[token]
            if open_at[end] and (not out or ok(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = False  # refuted for good; the token that ends here gets shorter
                token = out.pop()
                at -= size_of[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        known = self.known
        for p in self.cut(text or ""):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode())
                if len(p) <= CACHE_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int] | None) -> str | None:
        """The text of ids; null for null. Bytes that are no UTF-8 become U+FFFD."""
        if ids is None:
            return None
        blob, offset = self.blob, self.offset
        return b"".join([blob[offset[i] : offset[i + 1]] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, on the driver."""
    return Codec(read_ranks(path))


_WORKER: dict[int, Codec] = {}


def _tables(df: DataFrame, path: str) -> Callable[[], Codec]:
    """The vocabulary's tables go out as a broadcast; the function gives a worker its codec, built once a process."""
    c = codec(path)
    stamp = zlib.crc32(c.blob)
    sent = df.sparkSession.sparkContext.broadcast((c.tokens, np.array(c.left), np.array(c.right)))

    def get() -> Codec:
        if stamp not in _WORKER:
            _WORKER.clear()
            _WORKER[stamp] = Codec(*sent.value)
        return _WORKER[stamp]

    return get


def encode(df: DataFrame, id_col: str, text_col: str, out_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``out_col`` ARRAY<INT>, one row for each row of the input; rows aren't shuffled."""
    get = _tables(df, path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in batches:
            lists = [c.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = pa.array([i for x in lists for i in x], type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, out_col])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col), F.col(text_col).alias("__ls_text")).mapInArrow(kernel, schema)


def decode(df: DataFrame, id_col: str, ids_col: str, out_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``out_col``: the texts of id lists; an empty list is the empty text, null stays null."""
    get = _tables(df, path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in batches:
            texts = pa.array([c.decode(x) for x in b.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[id_col, out_col])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out_col, T.StringType())])
    return df.select(F.col(id_col), F.col(ids_col).alias("__ls_ids")).mapInArrow(kernel, schema)

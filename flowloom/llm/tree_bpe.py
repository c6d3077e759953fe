"""Byte-level BPE by monoid tree reduction.

``encode`` halves a byte string (at a power of two) down to tokens and joins the encodings of
neighbours on the way up. A join re-encodes a window around the boundary: the last
tokens of the left side and the first of the right. The tokens outside it are final
as soon as the two pairs of tokens at the window's edges are stable, that is, each
pair's own bytes encode to that pair; otherwise the failing edge moves outwards.

Why that is enough: let every pair of neighbours in a token sequence be stable, and
run the merges of the whole string. Until a merge crosses a token's edge, each token's
bytes merge as they do alone, in the same order. The first merge across the edge of
two neighbours would then also happen when their bytes alone are encoded, which the
pair's stability excludes. So no merge crosses an edge, and the sequence is the
encoding of the whole string.

Decoding concatenates the tokens' bytes pairwise, up a balanced tree.

Null texts count as empty: no ids, and the hashes of empty input. Repeated rows each get their
row. An empty table stays empty. Long texts are taken whole. Other columns stay, whatever
their names; those named as an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import add_columns, quoted
from flowloom.llm.chunks import LONG, Recent, cut

#: Pieces of text of which a worker keeps the ids in each of two generations.
KEPT = 160_000
#: Parts of pre-tokens and pairs of tokens that a worker keeps; beyond it starts afresh.
KEPT_PARTS = 160_000
#: Tokens joined at once at the lowest level of decoding.
LEAF = 512
#: Bytes up to which a part is kept, and up to which a window is merged without a heap.
SMALL, SHORT = 8, 24
NONE = 1 << 31


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    def encode(self, word: bytes) -> tuple[int, ...]:
        if word in self.ranks:  # every token of such a vocabulary encodes to itself
            return (self.ranks[word],)
        found = self.parts.get(word)
        if found is None:
            half = 1 << (len(word) - 1).bit_length() - 1  # so that words share their parts
            found = self.join(self.encode(word[:half]), self.encode(word[half:]))
            if len(word) <= SMALL:
                self.keep_part(word, found)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        i, j = 1, 1  # tokens of each side in the window
        window = self.pair(left[-1], right[0])
        if len(window) == 2 and window[0] == left[-1]:
            return left + right
        while True:
            left_done = i == len(left) or self.is_stable(left[-i - 1], window[0])
            right_done = j == len(right) or self.is_stable(window[-1], right[j])
            if left_done and right_done:
                return left[: len(left) - i] + window + right[j:]
            i = i if left_done else min(2 * i, len(left))
            j = j if right_done else min(2 * j, len(right))
            window = self.merge(b"".join([self.bytes[t] for t in left[len(left) - i :] + right[:j]]))

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes together."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > KEPT_PARTS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b])
        return found

    def is_stable(self, a: int, b: int) -> bool:
        return self.pair(a, b) == (a, b)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The merges of a window, by rank, from the left among equals."""
        if len(word) > SHORT:
            return self.merge_long(word)
        found = self.parts.get(word)
        if found is not None:
            return found
        rank = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        of = [rank(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while of and (low := min(of)) < NONE:
            i = of.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del of[i]
            if i < len(of):
                of[i] = rank(parts[i] + parts[i + 1], NONE)
            if i:
                of[i - 1] = rank(parts[i - 1] + parts[i], NONE)
        found = tuple([self.ranks[p] for p in parts])
        if len(word) <= SMALL:
            self.keep_part(word, found)
        return found

    def keep_part(self, word: bytes, ids: tuple[int, ...]) -> None:
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        self.parts[word] = ids

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs over a linked list."""
        n = len(word)
        rank, end = self.ranks.get, list(range(1, n + 1))  # a symbol begins at i and ends at end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (k := end[i]) >= n or end[k] != stop or k >= stop:
                continue
            alive[k], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def decode(self, ids: array) -> bytes:
        get = self.bytes.__getitem__
        level = [b"".join(map(get, ids[i : i + LEAF])) for i in range(0, len(ids), LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def _coder(path: str):
    import regex
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:  # a library's file on each machine, not an input
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tree = TreeEncoder(ranks)
    find = regex.compile(PATTERN).findall
    of_piece = Recent(KEPT)

    def whole(text: str) -> bytes:
        ids = array("I")
        for w in find(text):
            ids.extend(tree.encode(w.encode()))
        return ids.tobytes()

    def encode(text: str) -> array:
        of_piece.age()
        pieces = cut(text)
        first, passing = pieces[0], {}
        for p in of_piece.absent(set(pieces[1:])):
            (of_piece.now if len(p) <= LONG else passing)[p] = whole(" " + p)
        look = of_piece.now.__getitem__ if not passing else lambda p: passing[p] if p in passing else of_piece.now[p]
        return array("I", whole(first) + b"".join(map(look, pieces[1:])))

    return encode, tree.decode


def encode_bpe(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", check: bool = False) -> DataFrame:
    """``df`` with the column ids array<int>; special tokens are ordinary text. With ``check``
    the ids are decoded again, and should they not give the text, the task fails."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        import public_tokenizers

        encode, decode = _coder(public_tokenizers.path(vocabulary))
        for (texts,) in batches:
            ids, ends = array("I"), array("i", [0])
            for t in texts.to_pylist():
                own = encode(t or "")
                if check and decode(own) != (t or "").encode():
                    raise ValueError(f"token ids do not decode to their text: {(t or '')[:40]!r}")
                ids.extend(own)
                ends.append(len(ids))
            yield [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))]

    return add_columns(df, [text], "ids array<int>", run)


def decode_bpe(df: DataFrame, ids: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``df`` with the column decoded binary: the bytes that the ids stand for (null: empty)."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        import public_tokenizers

        _, decode = _coder(public_tokenizers.path(vocabulary))
        for (lists,) in batches:
            yield [[decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in lists]]

    return add_columns(df, [ids], "decoded binary", run)


def bpe_digests(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and
    decoded_sha256 (of the bytes decoded again), without moving ids out of the tasks."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        import sys

        import public_tokenizers

        encode, decode = _coder(public_tokenizers.path(vocabulary))
        for (texts,) in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in texts.to_pylist():
                ids = encode(t or "")
                counts.append(len(ids))
                of_bytes.append(hashlib.sha256(decode(ids)).hexdigest())
                if sys.byteorder == "big":
                    ids.byteswap()
                of_ids.append(hashlib.sha256(ids).hexdigest())
            yield [counts, of_ids, of_bytes]

    return add_columns(df, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def round_trip(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is not what its ids decode to (there are none)."""
    out = decode_bpe(encode_bpe(df, text))
    return out.where(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary") != F.col("decoded"))


"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a slice of texts are laid out as one ragged numpy array:
all symbols in a row, with the number of the sequence that each belongs to. In each
round every sequence merges all places of its lowest-rank pair at once (from the left
where they overlap), and sequences without a mergeable pair leave the array. What is
left of a sequence is its token count.

Merging all places of one pair together gives what merging them one by one gives,
because a symbol made by a merge only takes part in pairs of higher rank.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows each get their row. An empty
table stays empty. Long texts are taken whole. Other columns stay, whatever their names;
those named as an output are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import add_columns, quoted, slices
from flowloom.llm.chunks import LONG, Recent, cut

#: Pre-tokens, and pieces of text, of which a worker keeps the counts in each of two generations.
KEPT = 200_000

#: Ranges in which the Unicode versions of the libraries agree on letters,
#: numbers and white space. Texts with other characters are split by the library.
SETTLED = "\x00-՗֍-ࢎ࢐-౛ౝ-೛ೝ-₎ₐ-ₜ₠-ꟍ가-힣豈-﫿︀-﻿\U0001f300-\U0001faff"

NO_PAIR = np.int32(np.iinfo(np.int32).max)


class RankMerger:
    """Counts what is left of byte strings after all merges of a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_PAIR)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = sizes.copy()
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), NO_PAIR, np.int32)  # of the pair that begins at each symbol
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NO_PAIR
            counts[owner[starts[over]]] = lengths[over]
            chosen = (ranks == np.repeat(lowest, lengths)) & (ranks != NO_PAIR)
            chosen &= self.leftmost(chosen)
            gone = np.r_[False, chosen[:-1]]
            at = np.flatnonzero(chosen)
            symbols[at] = self.made[ranks[at]]
            stay = ~gone & ~np.repeat(over, lengths)
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, owner, ranks, changed = symbols[stay], owner[stay], ranks[stay], changed[stay]
            if not len(symbols):
                break
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            ranks[again] = NO_PAIR
            again = again[again < len(symbols) - 1]
            again = again[owner[again] == owner[again + 1]]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        return counts

    @staticmethod
    def leftmost(chosen: np.ndarray) -> np.ndarray:
        """Of places that follow one another (a pair of equal symbols), every second from the left."""
        at = np.flatnonzero(chosen)
        run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1 if len(at) else at
        place = np.arange(len(at)) - np.searchsorted(run, run)
        out = np.zeros(len(chosen), bool)
        out[at] = place % 2 == 0
        return out


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def _counter(path: str):
    import regex
    from public_tokenizers import PATTERN
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as file:  # a library's file on each machine, not an input
        spec = json.load(file)
    merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    inside = regex.compile("|".join(map(regex.escape, special))) if special else None
    library = pre_tokenizers.ByteLevel(add_prefix_space=False)
    odd = regex.compile(f"[^{SETTLED}]")
    find = regex.compile(PATTERN).findall
    of_word, of_piece = Recent(KEPT), Recent(KEPT)

    def split(text: str) -> list[str]:
        if odd.search(text):
            return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        return find(text)

    def learn(parts: set[str], cautious: bool) -> dict[str, list[str]]:
        """The words of each part; their counts are known after this."""
        words = {p: split(p) for p in parts} if cautious else {p: find(p) for p in parts}
        for some in slices(of_word.absent({w for ws in words.values() for w in ws})):
            of_word.now.update(zip(some, merger.count([w.encode() for w in some]).tolist(), strict=True))
        return words

    def count(texts: list[str]) -> list[int]:
        out: list[int] = []
        for run in slices(texts):
            of_word.age()
            of_piece.age()
            cuts = [[cut(p) for p in (inside.split(text) if inside else [text])] for text in run]
            new = of_piece.absent({p for text in cuts for pieces in text for p in pieces[1:]})
            words = learn({" " + p for p in new} | {pieces[0] for text in cuts for pieces in text}, any(odd.search(text) for text in run))
            count_word, passing = of_word.now.__getitem__, {}
            for p in new:
                (of_piece.now if len(p) <= LONG else passing)[p] = sum(map(count_word, words[" " + p]))
            look = of_piece.now.__getitem__ if not passing else lambda p: passing[p] if p in passing else of_piece.now[p]
            for text in cuts:
                n = len(text) - 1
                for pieces in text:
                    n += sum(map(count_word, words[pieces[0]])) + sum(map(look, pieces[1:]))
                out.append(n)
        return out

    return count


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """``df`` with n_bytes, n_tokens (without begin or end tokens) and over_limit.

    A special token's own string inside a text counts as that one token, which is the
    library's default. Columns of those three names are replaced.
    """

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        import public_tokenizers

        count = _counter(public_tokenizers.path(vocabulary))
        for (texts,) in batches:
            yield [np.array(count([t or "" for t in texts.to_pylist()]), np.int64)]

    out = add_columns(df, [text], "n_tokens long", run)
    size = F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long")
    kept = [c for c in out.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    return out.select(*[F.col(quoted(c)) for c in kept], size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


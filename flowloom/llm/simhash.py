"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks; if two fingerprints differ in at most four bits, some
block differs in few. In each block the anchors are the words of a covering code: a perfect
Hamming code (covering radius 1) next to the block's other bits as they are. A fingerprint
goes to every anchor within the radius plus what a block may differ in. Of two that differ
no more there, the nearest anchor of either is so near to the other that they meet at an
anchor. At the anchors whole fingerprints are compared, so the result is exact.

There are two layouts. Three blocks, of which one differs in at most one bit, with a code of
length 15 send a fingerprint to 45 anchors of 2^17 or 2^18 a block. Two blocks, of which one
differs in at most two bits, with a code of length 31 send it to up to 343 anchors of 2^27 a
block, so that an anchor has some hundred times fewer rows. The number of distinct
fingerprints, which is counted, tells which is less work; both give all links.

Equal fingerprints are one from the start. An anchor reports its links as a forest, not
as all pairs, and an anchor with more rows than ``CHUNK`` is cut into chunks that are
compared two at a time in different tasks.

Null and blank texts have fingerprint zero and link like any other. Repeated rows stay, each
with its row. An empty table gives no rows. A long text is taken whole. Only the key and the
computed columns are returned, so other columns, whatever their names, are not in the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import add_columns, map_batches, quoted, slices, utf8
from flowloom.llm.components import connected
from flowloom.session import forget, keep

BITS, THRESHOLD = 64, 4
#: The covering radius of the codes, and what moving a row to an anchor costs in comparisons there.
RADIUS, MOVE = 1, 1_000
#: Rows of one anchor that a task takes at once.
CHUNK = 8_192
#: Groups of at most this size are compared many at a time.
FEW = 64


def shingle_hashes(data: bytes, size: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-size] + 1].tolist()
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def simhashes(texts: list[bytes], size: int = 4) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    for run in slices(texts, most=1 << 20):
        hashes = [shingle_hashes(t, size) for t in run]
        sizes = np.fromiter(map(len, hashes), np.int64, len(run))
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            major = (2 * votes > sizes[some][:, None]).astype(np.uint8)
            out[at + some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
        at += len(run)
    return out.view(np.int64)


def with_simhash(df: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """``df`` with the column fingerprint long, over shingles of ``size`` words."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (texts,) in batches:
            yield [simhashes(utf8(texts), size)]

    return add_columns(df, [text], "fingerprint long", run)


@dataclass(frozen=True)
class Layout:
    """First bit and width of each block, and the length of the code over its low bits."""

    blocks: tuple[tuple[int, int], ...]
    code: int

    @property
    def reach(self) -> int:
        """Bits to the farthest anchor of a block: of some block not more than an even share differ."""
        return RADIUS + THRESHOLD // len(self.blocks)

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        """The exclusive or of the numbers (from 1) of the set bits that the code covers; 0 in its words."""
        out = np.zeros(len(values), np.int64)
        for bit in range(self.code):
            out ^= (values >> bit & 1) * (bit + 1)
        return out

    def patterns(self, width: int) -> list[np.ndarray]:
        """For each syndrome the bit patterns within reach that lead to an anchor."""
        found: list[list[int]] = [[] for _ in range(self.code + 1)]
        for weight in range(self.reach + 1):
            for bits in combinations(range(width), weight):
                found[reduce(xor, (b + 1 for b in bits if b < self.code), 0)].append(sum(1 << b for b in bits))
        return [np.array(x, np.int64) for x in found]

    def work(self, prints: int) -> float:
        """About how many comparisons the links of so many fingerprints take, moves included."""
        total = 0.0
        for _, width in self.blocks:
            copies = max(map(len, self.patterns(width)))
            total += prints * copies * (MOVE + prints * copies / 2 ** (width - self.code.bit_length()) / 2)
        return total


LAYOUTS = (Layout(((0, 22), (22, 21), (43, 21)), 15), Layout(((0, 32), (32, 32)), 31))


def anchors_of(prints: np.ndarray, layout: Layout = LAYOUTS[0]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, anchor, row) of all anchors that each fingerprint goes to."""
    for number, (first, width) in enumerate(layout.blocks):
        part = prints.view(np.uint64) >> np.uint64(first) & np.uint64((1 << width) - 1)
        part = part.astype(np.int64)
        of = layout.syndrome(part)
        for s, flips in enumerate(layout.patterns(width)):
            rows = np.flatnonzero(of == s)
            for some in np.array_split(rows, max(1, len(rows) * len(flips) // 200_000)):
                yield number, (part[some, None] ^ flips).ravel(), np.repeat(some, len(flips))


def _dealt(prints: DataFrame, layout: Layout) -> DataFrame:
    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (values,) in batches:
            numbers = values.to_numpy(zero_copy_only=False)
            for block, anchor, rows in anchors_of(numbers, layout):
                if len(rows):
                    yield [anchor << 2 | block, numbers[rows]]

    return map_batches(prints, ["fingerprint"], "anchor long, fingerprint long", run)


def forest(values: np.ndarray, most: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, root) that join what is reachable within ``most`` bits, one for each value but roots."""
    left = np.unique(values)
    ups: list[np.ndarray] = []
    roots: list[np.ndarray] = []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count(front[i : i + 256, None] ^ left[None, :]) <= most).any(axis=0)
            front, left = left[near], left[~near]
            ups.append(front)
            roots.append(np.full(len(front), root))
    empty = values[:0]
    return np.concatenate([empty, *ups]), np.concatenate([empty, *roots])


def links_in_groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key (sorted), as (value, value) pairs."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for start, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        a, b = forest(values[start : start + n])
        left.append(a)
        right.append(b)
    few = (sizes > 1) & (sizes <= FEW)
    begin, count = starts[few], sizes[few]
    for step in range(1, int(count.max()) if len(count) else 0):  # each row with the one so many places on
        more = count > step
        begin, count = begin[more], count[more]
        width = count - step
        at = np.repeat(begin - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(int(width.sum()))
        near = np.bitwise_count(values[at] ^ values[at + step]) <= THRESHOLD
        left.append(values[at[near] + step])
        right.append(values[at[near]])
    empty = values[:0]
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(prints: DataFrame, layout: Layout | None = None) -> DataFrame:
    """(u, v) links of distinct fingerprints; all within THRESHOLD bits, or of one group that is joined by such."""
    if layout is None:
        n = prints.count()
        layout = min(LAYOUTS, key=lambda x: x.work(n))
    dealt = _dealt(prints, layout)
    crowded = keep(dealt.groupBy("anchor").count().where(F.col("count") > CHUNK).select("anchor", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "crowded")
    dealt = dealt.join(crowded, "anchor", "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    cell = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(own, j) * 1_000_000 + F.greatest(own, j))))
    dealt = dealt.select("anchor", cell.alias("cell"), "fingerprint")
    dealt = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "fingerprint")

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        rest: tuple[np.ndarray, ...] | None = None
        for arrays in batches:
            anchor, cell, value = (x.to_numpy(zero_copy_only=False) for x in arrays)
            if rest is not None:
                anchor, cell, value = (np.concatenate(x) for x in zip(rest, (anchor, cell, value), strict=True))
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            rest = (anchor[last:], cell[last:], value[last:])
            if last:
                yield list(links_in_groups(np.cumsum(new)[:last], value[:last]))
        if rest is not None and len(rest[0]):
            yield list(links_in_groups(np.zeros(len(rest[0]), np.int64), rest[2]))

    return map_batches(dealt, ["anchor", "cell", "fingerprint"], "u long, v long", run).distinct()


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): one row for each row of ``df``.

    component_id is the least key reachable over links, the row's own included; keys may
    repeat, and a null key is never the least unless its whole group has no other.
    """
    asked = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    marked = keep(with_simhash(asked, "text", size).select("key", "fingerprint"), "simhash")
    prints = keep(marked.groupBy("fingerprint").agg(F.min("key").alias("first")), "prints")
    found = keep(links(prints.select("fingerprint")), "links")
    roots = connected(found).select(F.col("u").alias("fingerprint"), F.col("v").alias("root"))
    grouped = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = keep(grouped.join(first, "root").select("fingerprint", "component_id"), "groups")
    forget(prints, found, roots)
    return marked.join(of_print, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")

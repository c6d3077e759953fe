"""Near-duplicates of a stated similarity by wide SimHashes and anchor-point covering.

Four bits of 64 are few for copies that share four in five of their shingles: about 0.15 of
all bits differ. Here a fingerprint has 256 bits, and two texts are linked if at most ``NEAR``
differ, which tells a similarity of 0.8 apart from less.

Pairs are found in six blocks of 24 bits. In a block the anchors are the words of a Hamming
code of length 15 (covering radius 1) next to nine bits as they are, and a fingerprint goes to
every anchor within the radius plus one. If two differ in at most two bits of a block, some
word is within one bit of both; the anchor nearest to it is within reach of both, so they
meet there. Of pairs of a similarity of 0.8 about 0.86 meet in some block, of 0.9 0.99. What
meets is compared by whole fingerprints; links are by the fingerprints, not by the texts.

Equal fingerprints are one from the start. Links are found in two rounds. The first takes
only the anchors within the radius, which are few, and joins most of a large group of copies.
The second takes all anchors and links what the first has left apart: rows that it joined
bear one label, and only rows of different labels are compared. Either reports a forest over
the labels that a task has at hand, never all pairs, so the number of links grows with a
group's size, not with its square. An anchor with more rows than ``CHUNK`` is cut into chunks
that are compared two at a time in different tasks.

Null and blank texts have fingerprint zero and are a group. Repeated rows stay, each with its
row. An empty table gives no rows. A long text is taken whole, its shingles in parts. Only
the key and the computed column are returned, so other columns are not in the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import map_batches, quoted, slices, utf8
from flowloom.llm.components import connected
from flowloom.llm.simhash import CHUNK, FEW, RADIUS, Layout, anchors_of, shingle_hashes
from flowloom.session import forget, keep

#: 64-bit parts of a fingerprint; bits in which linked ones differ at most (0.8: 39 on average).
PARTS, NEAR = 4, 45
#: Parts that blocks are taken from, two each.
BANDED = 3
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Bands(Layout):
    @property
    def reach(self) -> int:
        """Bits to the farthest anchor: half of the two bits that a block may differ in, and the radius."""
        return RADIUS + 1


@dataclass(frozen=True)
class Seeds(Bands):
    @property
    def reach(self) -> int:
        """Bits to the nearest anchor; those anchors are among the ones of ``Bands``."""
        return RADIUS


BANDS, SEEDS = Bands(((0, 24), (24, 24)), 15), Seeds(((0, 24), (24, 24)), 15)


def part_of(hashes: np.ndarray, part: int) -> np.ndarray:
    """The part of a fingerprint's hash that a shingle's 64-bit hash leads to; the first is itself."""
    if not part:
        return hashes
    h = hashes + np.uint64(part * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def wide_simhashes(texts: list[bytes], size: int = 5) -> np.ndarray:
    """A row of PARTS unsigned 64-bit integers for each text, over shingles of ``size`` words."""
    out = [np.zeros((0, PARTS), np.uint64)]
    for run in slices(texts, most=1 << 20):
        hashes = [shingle_hashes(t, size) for t in run]
        sizes = np.fromiter(map(len, hashes), np.int64, len(run))
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(run)), sizes)
        votes = np.zeros((len(run), 64 * PARTS), np.int64)
        for i in range(0, len(flat), AT_ONCE):
            some, of = flat[i : i + AT_ONCE], owner[i : i + AT_ONCE]
            bits = np.stack([part_of(some, p) for p in range(PARTS)], axis=1).view(np.uint8)
            bits = np.unpackbits(bits, axis=1, bitorder="little")
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            votes[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out)


def _column(prints: np.ndarray) -> pa.Array:
    prints = np.ascontiguousarray(prints)
    return pa.Array.from_buffers(pa.binary(8 * PARTS), len(prints), [None, pa.py_buffer(prints)]).cast(pa.binary())


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARTS)


def _near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within NEAR bits; the last axis is that of the parts."""
    bits = np.bitwise_count(one[..., 0] ^ other[..., 0]).astype(np.uint16)
    for p in range(1, PARTS):
        bits += np.bitwise_count(one[..., p] ^ other[..., p])
    return bits <= NEAR


def _joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``roots``, the least of what each label is joined to, with labels a and b joined as well."""
    while len(a):
        x, y = roots[a], roots[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while ((up := roots[roots]) != roots).any():
            roots = up
    return roots


def join_group(roots: np.ndarray, labels: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """``roots`` with the labels of near fingerprints at one anchor joined; those that are joined already are not compared."""
    order = np.argsort(roots[labels], kind="stable")
    labels, prints = labels[order], prints[order]
    n = len(labels)
    step = max(1, (1 << 19) // max(n, 1))
    for i in range(0, n, step):
        own = roots[labels]
        others = np.arange(i, n)
        if (own[i : i + step] == own[i]).all():
            others = others[own[i:] != own[i]]
        if len(others):
            a, b = np.nonzero(_near(prints[i : i + step, None], prints[None, others]))
            roots = _joined(roots, labels[a + i], labels[others[b]])
    return roots


def links_in_groups(keys: np.ndarray, prints: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (label, label), a forest, that join what is near among rows of equal key (sorted).
    Labels are numbers from 0, that of the row by default; what has one label is joined already."""
    labels = np.arange(len(keys)) if labels is None else labels
    roots = np.arange(int(labels.max()) + 1 if len(labels) else 0)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    sizes = np.diff(np.r_[starts, len(keys)])
    few = (sizes > 1) & (sizes <= FEW)
    begin, count = starts[few], sizes[few]
    for step in range(1, int(count.max()) if len(count) else 0):  # each row with the one so many places on
        more = count > step
        begin, count = begin[more], count[more]
        width = count - step
        at = np.repeat(begin - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(int(width.sum()))
        at = at[roots[labels[at]] != roots[labels[at + step]]]
        at = at[_near(prints[at], prints[at + step])]
        roots = _joined(roots, labels[at], labels[at + step])
    for start, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        roots = join_group(roots, labels[start : start + n], prints[start : start + n])
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return linked, roots[linked]


def _anchors(prints: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in range(BANDED):
        for block, anchor, rows in anchors_of(np.ascontiguousarray(prints[:, part]).view(np.int64), bands):
            if len(rows):
                yield (anchor << 3 | 2 * part + block).astype(np.int32), rows


def links(prints: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """(u, v) links that join the labels of near fingerprints (columns print, each once, and label).
    A label is one of the fingerprints that bear it, and null is the fingerprint itself."""

    def deal(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for values, labels in batches:
            numbers = _numbers(values)
            for anchor, rows in _anchors(numbers, bands):
                yield [anchor, _column(numbers[rows]), labels.take(pa.array(rows))]

    def count(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (values,) in batches:  # an anchor is told once a batch
            anchors = [anchor for anchor, _ in _anchors(_numbers(values), bands)]
            if anchors:
                yield list(np.unique(np.concatenate(anchors), return_counts=True))

    counts = map_batches(prints, ["print"], "anchor int, n long", count).groupBy("anchor").agg(F.sum("n").alias("n"))
    crowded = keep(counts.where(F.col("n") > CHUNK).select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "crowded")
    dealt = map_batches(prints, ["print", "label"], "anchor int, print binary, label binary", deal).join(crowded, "anchor", "left")
    # a row of a crowded anchor goes to the cells of its chunk with each other one
    own, chunks = F.pmod(F.xxhash64("print"), F.col("chunks")), F.col("chunks")
    cells = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    cell = F.explode(F.when(chunks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells))
    dealt = dealt.select("anchor", cell.alias("cell"), "print", "label").repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")

    def compare(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        rest: list[pa.Array] | None = None

        def told(new: np.ndarray, values: pa.Array, labels: pa.Array) -> list:
            coded = pc.coalesce(labels, values).dictionary_encode()
            a, b = links_in_groups(np.cumsum(new), _numbers(values), coded.indices.to_numpy().astype(np.int64))
            return [coded.dictionary.take(pa.array(a)), coded.dictionary.take(pa.array(b))]

        for batch in batches:
            now = batch if rest is None else [pa.concat_arrays(x) for x in zip(rest, batch, strict=True)]
            anchor, cell = (x.to_numpy(zero_copy_only=False) for x in now[:2])
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])][: len(anchor)]
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            rest = [x[last:] for x in now]
            if last:
                yield told(new[:last], *(x[:last] for x in now[2:]))
        if rest is not None and len(rest[0]):
            yield told(np.arange(len(rest[0])) == 0, *rest[2:])

    return map_batches(dealt, ["anchor", "cell", "print", "label"], "u binary, v binary", compare).distinct()


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(key, component_id): one row for each row of ``df``, with the least key reachable over
    links, its own included. Keys may repeat; a null key is the least only of a group without others."""

    def mark(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for keys, texts in batches:
            yield [keys, _column(wide_simhashes(utf8(texts), size))]

    asked = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    marked = keep(map_batches(asked, ["key", "text"], f"key {asked.schema['key'].dataType.simpleString()}, print binary", mark), "wide")
    prints = keep(marked.groupBy("print").agg(F.min("key").alias("first")), "prints")
    seeds = connected(links(prints.select("print", F.lit(None).cast("binary").alias("label")), SEEDS))
    labels = seeds.select(F.col("u").alias("print"), F.col("v").alias("label"))
    labelled = keep(prints.select("print").join(labels, "print", "left"), "labels")
    joined = connected(seeds.unionAll(links(labelled)))
    roots = joined.select(F.col("u").alias("print"), F.col("v").alias("root"))
    grouped = prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    first = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = keep(grouped.join(first, "root").select("print", "component_id"), "groups")
    forget(prints, seeds, labelled, joined)
    return marked.join(of_print, "print").select(F.col("key").alias(key), "component_id")

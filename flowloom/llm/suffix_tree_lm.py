"""Language-model scoring with a probabilistic suffix tree over words.

A state is a context of up to ``DEPTH`` words, the tree's largest memory. The root has every
word of the corpus, with additive smoothing. A deeper context is a candidate if it occurs at
least ``LEAST_STATE`` times, and becomes a state if its next-symbol distribution diverges
from that of the shorter context (its suffix) by more than its size explains. A state keeps
the symbols that follow it at least ``LEAST_STEP`` times, less a discount; what is left of
its probability goes to its suffix's distribution. So the probabilities of all symbols after
any context sum to 1, and the longest state that a text's last words end in decides.

The least counts are numbers, not shares: what two texts have in common is in the model, and
the model grows with the texts. Its parts are Spark tables. Words are known by 127 bits of
two hashes, in counts and joins alike; n-grams by 64 bits, each the hash of those of the
n-gram without its last and without its first word: a clash of these would alter a score, no
count. The divergence test is a grouped aggregate. The log probability of a token is a sum
over the n-grams that end there: what the n-gram adds to its suffix as a step, and what the
context leaves as a state. So a text is scored by its n-grams, whatever their places, in one
join with a table of weights.

What is sent to tasks has a bound whatever the input: the weights of at most ``HOT`` frequent
n-grams, which are in no join, and bitmaps of at most ``BITS`` bits that tell which n-grams
may have a weight; a full bitmap costs rows in a join and changes no result.

A text is its words and one end. A null text is an end alone. A row whose key is null is
neither learned from nor held out. Repeated rows each get their row, and are learned from each.
An empty table gives no rows. A long text is taken whole, alone in its slice. Only the key
and the computed columns are returned, so other columns of ``df``, whatever their names, are
not in the way.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from flowloom.llm.batches import batches_by_rows, map_batches, quoted
from flowloom.session import forget, keep, release_shuffles

#: Words of the longest context; least occurrences of a state and of a step.
DEPTH, LEAST_STATE, LEAST_STEP = 3, 8, 2
#: Additive smoothing of the root, and discount of the steps.
ALPHA, DISCOUNT = 0.1, 0.6
#: N-grams whose weights are sent to tasks at most, and most bits of a bitmap.
HOT, BITS = 1 << 18, 1 << 27
#: Hashes whose bits of a bitmap are set together, about, as a power of two.
STRETCH = 20
#: First bits of the three parts of a hash that tell which bits of a bitmap's word it sets.
MARKS = (28, 34, 40)
#: The end of a text, also the context that its first word has; no word is a line feed.
END = b"\n"
#: Hashes that are made together, few enough for a core's cache.
CACHED = 1 << 14
#: Bytes of text that a task takes at once, and rows that it hands on at once.
RUN_BYTES, AT_ONCE = 4 << 20, 100_000
#: Bytes of text that are scored at once.
SCORE_BYTES = 1 << 20
#: Bytes of text whose n-grams are added up together.
RANGE_BYTES = 8 << 20
#: Ranges that n-grams are dealt into over the network, as a power of two; finer ones are made where these arrive.
COARSE = 12
#: Bytes of n-grams that are added up before they are dealt into finer ranges.
SPLIT_BYTES = 64 << 20
#: Bytes of text whose n-grams meet their weights together.
WEIGH_BYTES = 16 << 20
#: In how many passes n-grams meet their weights, as a power of two; one pass's are on the disks at a time.
PASSES = 1
#: Texts of a run at most, and n-grams of one text in a row: both are told by 16 bits.
MOST = (1 << 16) - 1

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


#: Keeps a table of hashes, which hardly repeat: to try a dictionary of them costs time only.
_keep = partial(keep, **{"parquet.enable.dictionary": "false"})


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _hash(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of numbers of 64 bits, in place of one array."""

    def turn(x: np.ndarray, k: int) -> None:
        np.right_shift(x, np.uint64(64 - k), out=rest)
        np.left_shift(x, np.uint64(k), out=x)
        np.bitwise_or(x, rest, out=x)

    def fold(x: np.ndarray, k: int) -> None:
        np.right_shift(x, np.uint64(k), out=rest)
        np.bitwise_xor(x, rest, out=x)

    h = value * _P2
    rest = np.empty_like(h)
    turn(h, 31)
    h *= _P1
    h ^= seed + (_P5 + np.uint64(8))
    turn(h, 27)
    h *= _P1
    h += _P4
    for k, factor in ((33, _P2), (29, _P3)):
        fold(h, k)
        h *= factor
    fold(h, 32)
    return h


def gram_hash(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those without their last and without their first word: Spark's
    xxhash64 of both columns."""
    out = np.empty(len(prefix), np.uint64)
    for i in range(0, len(out), CACHED):
        some = slice(i, i + CACHED)
        out[some] = _hash(suffix[some], _hash(prefix[some], np.uint64(42)))
    return out


def longer(grams: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of one word more, by where they begin."""
    return gram_hash(grams[:-1], grams[1:])


#: The seeds of a word's two hashes, and words of more bytes than LANED are hashed by XXH3.
_SEEDS, LANED = (np.uint64(42), _P3), 64


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kinds: int = 2) -> list[np.ndarray]:
    """Two hashes of 64 bits of each stretch of the bytes, or the first of them, the second one odd:
    XXH64's rounds, with two seeds, over the length and the lanes of 8 bytes, the last filled up with zeros."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))  # the lane that begins at each byte

    def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        rest = (8 - np.minimum(left, 8) << 3).view(np.uint64)  # bits of what follows
        out = lanes[at]
        out <<= rest
        out >>= rest
        return out

    size = end - begin
    out = [np.empty(len(begin), np.uint64) for _ in range(kinds)]
    for i in range(0, len(begin), CACHED):
        some = slice(i, i + CACHED)
        first, length = lane(begin[some], size[some]), size[some].view(np.uint64) * _P4
        for x, seed in zip(out, _SEEDS, strict=False):
            x[some] = _hash(first, length + seed)
    more = np.flatnonzero(size > 8)
    for done in range(8, LANED, 8):
        more = more[size[more] > done]
        if not len(more):
            break
        next_ = lane(begin[more] + done, size[more] - done)
        for x in out:
            x[more] = _hash(next_, x[more])
    if len(long := np.flatnonzero(size > LANED)):
        from xxhash import xxh3_128_digest

        codes = b"".join(xxh3_128_digest(data[i:j].tobytes()) for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True))
        for x, h in zip(out, np.frombuffer(codes, ">u8").reshape(-1, 2).T, strict=False):
            x[long] = h
    for x in out[1:]:
        x |= np.uint64(1)
    return out


@dataclass
class Symbols:
    """The symbols of some texts in a row, each text between two ends."""

    owner: np.ndarray  # the text of the symbol at each place
    starts: np.ndarray  # where each text begins
    low: np.ndarray  # the two hashes of each symbol
    high: np.ndarray | None = None

    def inside(self) -> np.ndarray:
        """The places that count; the end before a text is none of it."""
        inside = np.ones(len(self.low), bool)
        inside[self.starts] = False
        return np.flatnonzero(inside)


def symbols(texts: pa.Array, kinds: int = 2) -> Symbols:
    """The symbols by two hashes, or by the first one."""
    lower = pc.ascii_lower(texts.fill_null(""))
    _, at, held = lower.buffers()
    edges = np.frombuffer(at, np.int64 if pa.types.is_large_string(lower.type) else np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    data = np.frombuffer(held or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    space = (data == 0x20) | (data - np.uint8(9) < 5)
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = edges[:-1] < edges[1:]
    first[edges[:-1][full]] = ~space[edges[:-1][full]]
    last[edges[1:][full] - 1] = ~space[edges[1:][full] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.repeat(np.arange(len(texts)), sizes := np.diff(np.searchsorted(begin, edges)))
    sizes = sizes + 2
    starts = np.cumsum(sizes) - sizes
    codes = [np.full(int(sizes.sum()), code[0]) for code in word_hashes(np.frombuffer(END, np.uint8), np.array([0]), np.array([len(END)]), kinds)]
    words = np.arange(len(owner)) + 2 * owner + 1
    for out, code in zip(codes, word_hashes(data, begin, end, kinds), strict=True):
        out[words] = code
    return Symbols(np.repeat(np.arange(len(texts)), sizes), starts, *codes)


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Where runs of texts of about ``most`` bytes, and not more than MOST texts, begin and end;
    a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (total + size > most or i - begin == MOST):
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _sorted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Their order, and the hashes in it. Numbers that hold a hash's first bits and its place are
    sorted without moving two arrays; the rare hashes that those bits do not tell apart are sorted in full."""
    bits = len(grams).bit_length()
    places = np.uint64((1 << bits) - 1)
    order = grams & ~places
    order |= np.arange(len(grams), dtype=np.uint64)
    order.sort()
    order &= places
    order = order.view(np.int64)
    out = grams[order]
    if (out[1:] < out[:-1]).any():
        order = np.argsort(grams)
        out = grams[order]
    return order, out


def _summed(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray | None, words: bool) -> tuple[np.ndarray, ...]:
    """(hash, prefix, suffix, n) of each n-gram once, by rising hash, with the sum of its
    numbers; words are told apart by both of their hashes."""
    order, grams = _sorted(all_ := gram_hash(prefix, suffix))
    new = grams[1:] != grams[:-1]
    if words:
        apart = lambda: (np.diff(prefix[order]) != 0) | (np.diff(suffix[order]) != 0)
        if (apart() & ~new).any():
            order = np.lexsort((suffix, prefix, all_))
            grams = all_[order]
            new = (grams[1:] != grams[:-1]) | apart()
    first = np.flatnonzero(np.r_[True, new][: len(grams)])
    n = np.diff(np.r_[first, len(grams)]) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    once = order[first]
    return grams[first], prefix[once], suffix[once], n


def _parts(*columns: np.ndarray) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(columns[0]), AT_ONCE):
        yield [c[i : i + AT_ONCE] for c in columns]


def gathered(batches: Iterator[list[pa.Array]], rows: int = 10 * AT_ONCE) -> Iterator[list[pa.Array]]:
    """The batches, put together to ``rows`` at least or all."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch[0])
        if n >= rows:
            yield [pa.concat_arrays(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [pa.concat_arrays(x) for x in zip(*held, strict=True)]


def giving_back(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` which at its end returns the memory it has freed to the system: a worker lives on
    between tasks, and what it holds is not there for the others of its executor."""

    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def _blocks(size: int, bits: int, grams: np.ndarray, *columns: np.ndarray) -> Iterator[list]:
    """What one row for each range of hashes holds of the n-grams, which rise: three arrays of 64 bits."""
    at = (grams >> np.uint64(64 - bits) if bits else np.zeros(len(grams), np.uint64)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    edges = np.r_[first, len(at)].tolist()
    blocks = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(edges, edges[1:], strict=False)]
    if blocks:
        yield [np.full(len(first), size, np.int8), at[first], pa.array(blocks, pa.binary())]


def _sum_of(size: int, blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    columns = [np.concatenate(x) for x in zip(*[np.frombuffer(x, np.uint64).reshape(3, -1) for x in blocks], strict=True)]
    return _summed(columns[0], columns[1], columns[2].view(np.int64), size == 1)


def counted(texts: DataFrame, text: str, grams_of: Callable[[pa.Array], Iterator[tuple]], room: int) -> DataFrame:
    """(size, a, b, n): the sums of what ``grams_of`` tells of runs of texts, (size, a, b, n) with
    words as size 1; n-grams, but words, that sum to less than LEAST_STEP are left out.

    A run's n-grams, each once, are dealt out by ranges of their hashes, which are fine
    enough for a range to hold the n-grams of about ``RANGE_BYTES`` of ``room`` bytes of text.
    A task adds up one range after the other. As a run sends an n-gram once, none is hot. Over
    the network go at most 2^COARSE ranges a size; the task that one arrives at deals it
    into its finer ones, so that neither partitions nor rows grow with the corpus squared.
    Two ranges are a task, as a task costs some time besides its rows.
    """
    bits = max(0, (max(room, 1) - 1) // RANGE_BYTES).bit_length()
    coarse = min(bits, COARSE)

    def deal(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (values,) in batches:
            for begin, end in runs(values):
                for size, a, b, n in grams_of(values.slice(begin, end - begin)):
                    yield from _blocks(size, coarse, *_summed(a, b, n, size == 1))

    def split(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        held, room = {}, 0
        for sizes, _, blocks in batches:
            for size, block in zip(sizes.to_pylist(), blocks, strict=True):
                held.setdefault(size, []).append(block.as_py())
                room += len(held[size][-1])
                if room > SPLIT_BYTES:
                    for size in list(held):
                        yield from _blocks(size, bits, *_sum_of(size, held.pop(size)))
                    room = 0
        for size, some in held.items():
            yield from _blocks(size, bits, *_sum_of(size, some))

    def add(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        def total() -> Iterator[list]:
            size = key[0]
            _, a, b, n = _sum_of(size, held)
            often = n >= (1 if size == 1 else LEAST_STEP)
            for a, b, n in _parts(a[often].view(np.int64), b[often].view(np.int64), n[often]):
                yield [np.full(len(a), size, np.int8), a, b, n]

        key, held = None, []
        for sizes, ranges, blocks in batches:
            for size, at, block in zip(sizes.to_pylist(), ranges.to_pylist(), blocks, strict=True):
                if held and key != (size, at):
                    yield from total()
                    held = []
                key = (size, at)
                held.append(block.as_py())
        if held:
            yield from total()

    dealt = map_batches(texts, [text], "size byte, at long, block binary", giving_back(deal))
    dealt = dealt.repartition(max(1, (1 << coarse) // 2), "size", "at")
    if coarse < bits:
        dealt = map_batches(dealt, ["size", "at", "block"], "size byte, at long, block binary", giving_back(split))
    dealt = dealt.sortWithinPartitions("size", "at")
    return map_batches(dealt, ["size", "at", "block"], "size byte, a long, b long, n long", giving_back(add))


def _words(texts: pa.Array) -> Iterator[tuple]:
    """The words by both of their hashes."""
    some = symbols(texts)
    at = some.inside()
    yield 1, some.low[at], some.high[at], None


def bitmap(grams: DataFrame, rows: int, column: str = "g", of: Callable[[pa.Array], np.ndarray] | None = None) -> np.ndarray:
    """64-bit words, a power of two of at most BITS bits, in which for each hash ``g`` those of
    its bits are set that its lowest bits tell the word of. ``of`` tells the hashes of a batch of
    the column. They are dealt out by stretches of words, and a task sets the bits of its stretches."""
    size = min(BITS, 1 << max(6, (16 * rows).bit_length())) // 64
    part = max(1, size >> (rows >> STRETCH).bit_length())
    low = part.bit_length() - 1

    def deal(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for (values,) in gathered(batches) if of is None else batches:
            g = values.to_numpy().view(np.uint64) if of is None else of(values)
            at = ((g & np.uint64(size - 1)) >> np.uint64(low)).astype(np.uint16)
            order = np.argsort(at, kind="stable")
            full, first = np.unique(at[order], return_index=True)
            edges = [*first.tolist(), len(g)]
            yield [full.astype(np.int32), [g[order[i:j]].tobytes() for i, j in zip(edges, edges[1:], strict=False)]]

    def mark(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        held = {}
        for stretches, blocks in batches:
            for at in pc.unique(stretches).to_pylist():
                flags = held[at] if at in held else held.setdefault(at, np.zeros(64 * part, bool))
                grams = np.frombuffer(b"".join(blocks.filter(pc.equal(stretches, at)).to_pylist()), np.uint64)
                for i in range(0, len(grams), CACHED):
                    g = grams[i : i + CACHED]
                    word = (g & np.uint64(part - 1)) << np.uint64(6)
                    for k in MARKS:
                        flags[(word | g >> np.uint64(k) & np.uint64(63)).view(np.int64)] = True
        for at, flags in held.items():
            yield [[at], [np.packbits(flags, bitorder="little").tobytes()]]

    with batches_by_rows(grams.sparkSession) if of is None else nullcontext():
        dealt = map_batches(grams, [column], "at int, block binary", deal).repartition(size // part, "at")
        marked = map_batches(dealt, ["at", "block"], "at int, bits binary", giving_back(mark)).collect()
    out = np.zeros(size, np.uint64)
    for at, block in marked:
        out[at * part : (at + 1) * part] = np.frombuffer(block, np.uint64)
    return out


def _may(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bitmap."""
    out = np.empty(len(grams), bool)
    for i in range(0, len(grams), CACHED):
        g = grams[i : i + CACHED]
        of = bits[(g & np.uint64(len(bits) - 1)).view(np.int64)]
        marks = [of >> (g >> np.uint64(k) & np.uint64(63)) for k in MARKS]
        out[i : i + CACHED] = marks[0] & marks[1] & marks[2] & np.uint64(1)
    return out


def _found(texts: DataFrame, text: str, size: int, sent: Broadcast, room: int) -> DataFrame:
    """(prefix, suffix, n) of the n-grams of that size that occur at least LEAST_STEP times
    after what may be a candidate; the suffix of such a one is known to occur so often.
    Sent are the bitmaps of candidates and of what is known."""

    def grams_of(texts: pa.Array) -> Iterator[tuple]:
        contexts, known = sent.value
        some = symbols(texts, kinds=1)
        grams = some.low
        for _ in range(size - 2):
            grams = longer(grams)
        if len(grams) > 1:
            good = np.flatnonzero(some.owner[: len(grams) - 1] == some.owner[size - 1 :])
            good = good[_may(contexts, grams[good])]
            good = good[_may(known, grams[good + 1])]
            yield size, grams[good], grams[good + 1], None

    return counted(texts, text, grams_of, room).select(F.col("a").alias("prefix"), F.col("b").alias("suffix"), "n")


def _states(candidates: DataFrame, steps: DataFrame) -> DataFrame:
    """(prefix, total, rest) of the candidates (prefix, total) that have steps; rest is what
    a context leaves to its suffix, null where it does not diverge enough to be a state."""
    n, total = F.col("n"), F.col("total")
    sums = steps.groupBy("prefix").agg(
        F.count("*").alias("kinds"),
        F.sum("n").alias("kept"),
        F.sum("below").alias("other"),
        F.sum(n * F.log(n / F.col("below"))).alias("gain"),
        F.sum(F.greatest(n - DISCOUNT, F.lit(0.0))).alias("shared"),
    )
    left = F.greatest(1 - F.col("kept") / total, F.lit(0.0))
    gain = F.col("gain") - F.col("kept") * F.log(total) + F.when(left > 0, left * total * F.log(left / F.greatest(1 - F.col("other"), F.lit(1e-12)))).otherwise(0.0)
    stays = gain > 0.5 * (F.col("kinds") + 1) * F.log(total)
    return sums.join(candidates, "prefix").select("prefix", "total", F.when(stays, 1 - F.col("shared") / total).alias("rest"))


def grow(texts: DataFrame, text: str, depth: int, room: int, bits: int) -> tuple[int, float, DataFrame]:
    """The model of the training texts, of ``room`` bytes: the number of tokens, the root's
    denominator, and its weights, a row (at, held, words, grams, adds, top) or two for each of 2^bits
    ranges of hashes: what each word (g, h, n, w) and each of ``held`` n-grams (g, and w in adds) adds
    to the score of a text, a word's root aside, by rising g; n is how often it occurs. Of the most
    frequent of them top has (g, h, n, w), n-grams with an h of 0."""
    words = _keep(counted(texts, text, _words, room).select(F.col("a").alias("g"), F.col("b").alias("h"), "n"), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = total + ALPHA * (kinds + 1)
    level = words.select("g", "n", ((F.col("n") + ALPHA) / floor).alias("p"))
    weights, kept = [], [words]
    for size in range(2, depth + 2):
        candidates = level.where(F.col("n") >= LEAST_STATE)
        known = level.where(F.col("n") >= LEAST_STEP)
        rows = level.agg(*[F.count_if(F.col("n") >= least) for least in (LEAST_STATE, LEAST_STEP)]).first()
        sent = texts.sparkSession.sparkContext.broadcast(tuple(bitmap(some, n) for some, n in zip((candidates, known), rows, strict=True)))
        found = _found(texts, text, size, sent, room)
        below = known.select(F.col("g").alias("suffix"), F.col("p").alias("below"))
        steps = _keep(found.join(below, "suffix"), "steps")
        del found
        release_shuffles(texts.sparkSession)
        states = _keep(_states(candidates.select(F.col("g").alias("prefix"), F.col("n").alias("total")), steps), "states")
        leaves = states.where("rest is not null").select(F.col("prefix").alias("g"), F.col("total").alias("n"), F.log10("rest").alias("w"))
        if size == 2:
            of_words = words.join(leaves.drop("n"), "g", "left").select("g", "h", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
        else:
            weights.append(leaves)
        stays = F.col("rest").isNotNull()
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("below")
        e = F.log10(F.col("p") / (F.col("below") * F.col("rest")))
        level = steps.join(states, "prefix").withColumn("p", F.when(stays, p).otherwise(F.col("below")))
        level = _keep(level.select(F.xxhash64("prefix", "suffix").alias("g"), "n", "p", F.when(stays, e).alias("e")), "level")
        weights.append(level.where("e is not null").select("g", "n", F.col("e").alias("w")))
        sent.destroy()
        forget(steps)
        kept += [states, level]
    with batches_by_rows(texts.sparkSession):
        packs = _packed(of_words, ["g", "h", "n", "w"], "words", bits).unionAll(_packed(reduce(DataFrame.unionAll, weights), ["g", "n", "w"], "grams", bits))
        weights = keep(packs, "weights")
    forget(*kept)
    release_shuffles(texts.sparkSession)
    return total, floor, weights


def _packed(weights: DataFrame, columns: list[str], kind: str, bits: int) -> DataFrame:
    """A row for each range of what ``grow`` tells of words, or of n-grams; the weights of one
    n-gram, which is there as a step and as a state, become one."""

    # hashes fall evenly on ranges, and it alters no result which n-grams are sent to tasks
    most = (HOT >> bits) + 4 * math.isqrt(HOT >> bits) + 1

    def pack(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        parts = list(zip(*batches, strict=True))
        if not parts:
            return
        parts = [np.concatenate([c.to_numpy() for c in x]) for x in parts]
        order, g = _sorted(parts[0].view(np.uint64))
        parts = [x[order] for x in parts[1:]]
        if kind == "grams":
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            g, n, w = g[first], np.maximum.reduceat(parts[0], first), np.add.reduceat(parts[1], first)
            h = np.zeros(len(g), np.int64)
        else:
            h, n, w = parts
        at = g >> np.uint64(64 - bits) if bits else np.zeros(len(g), np.uint64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        edges = [*first.tolist(), len(g)]
        for i, j in zip(edges, edges[1:], strict=False):
            columns = [x[i:j] for x in (g, h, n, w)]
            often = np.argsort(-columns[2], kind="stable")[:most]
            top, block = (b"".join(x.tobytes() for x in some) for some in ([x[often] for x in columns], columns))
            words, grams, adds = (b"", columns[0].tobytes(), columns[3].tobytes()) if kind == "grams" else (block, b"", b"")
            yield [at[i : i + 1].astype(np.int64), [len(grams) // 8], [words], [grams], [adds], [top]]

    place = F.shiftrightunsigned("g", 64 - bits) if bits else F.lit(0)
    # tasks of some ranges each, whatever number of partitions is set
    dealt = weights.repartition(max(1, (1 << bits) // 2), place)
    return map_batches(dealt, columns, "at long, held long, words binary, grams binary, adds binary, top binary", giving_back(pack))


def _table(block: bytes, *kinds: type) -> list[np.ndarray]:
    return _columns(block, len(block) // (8 * len(kinds)), *kinds)


#: The columns of words.
_WORDS = (np.uint64, np.uint64, np.int64, np.float64)


def most_frequent(weights: DataFrame, most: int | None = None) -> list[np.ndarray]:
    """(g, h, n, w) by falling n, ``most`` at most, of those that a range's tasks have told of."""
    rows = weights.select("top").toArrow()["top"]
    columns = [np.concatenate(x) for x in zip(*[_table(b"", *_WORDS), *[_table(x.as_py(), *_WORDS) for x in rows]], strict=True)]
    order = np.lexsort((columns[1], columns[0], -columns[2]))[: HOT if most is None else most]
    return [c[order] for c in columns]


@dataclass
class Slots:
    """Hot weights by the lowest bits of their hash; of those that fall on one slot the most frequent is there."""

    codes: np.ndarray  # an empty slot has a hash that belongs on another
    high: np.ndarray | None  # of words: the second hash, 0 on an empty slot as no word's is
    weight: np.ndarray
    root: np.ndarray | None

    def places(self, g: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and whether it is there."""
        place = (g & np.uint64(len(self.codes) - 1)).view(np.int64)
        here = self.codes[place] == g
        return place, here if h is None else here & (self.high[place] == h)


def _slots(hot: list[np.ndarray], floor: float) -> tuple[Slots, Slots]:
    """Those of the hot weights, by falling n, that are of words, and of n-grams."""
    g, h, n, w = hot
    out = []
    for some in (np.flatnonzero(h != 0), np.flatnonzero(h == 0)):
        size = 1 << (2 * len(some)).bit_length()
        slot, first = np.unique(g[some] & np.uint64(size - 1), return_index=True)
        slot, some = slot.astype(np.int64), some[first]
        codes, weight = ~np.arange(size, dtype=np.uint64), np.zeros(size)
        codes[slot], weight[slot] = g[some], w[some]
        high = root = None
        if not out:
            high, root = np.zeros(size, np.uint64), np.zeros(size)
            high[slot], root[slot] = h[some], np.log10((n[some] + ALPHA) / (floor or 1.0))
        out.append(Slots(codes, high, weight, root))
    return tuple(out)


class Index:
    """Where hashes are in a rising array of some of one range, by the bits that follow the range's."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.codes, self.bits, self.low = codes, np.uint64(bits), np.uint64(64 - max(1, len(codes).bit_length()))
        sizes = np.bincount(self.bucket(codes), minlength=1 << max(1, len(codes).bit_length()))
        self.start = np.r_[0, np.cumsum(sizes)].astype(np.int32)

    def bucket(self, g: np.ndarray) -> np.ndarray:
        return (g << self.bits >> self.low).astype(np.int64)

    def places(self, g: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """The place of each hash, the number of codes if it has none; of some places of one hash, that which ``fits``."""
        bucket = self.bucket(g)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(g), len(self.codes))
        open_ = np.flatnonzero(at < end)
        at, end, g = at[open_], end[open_], g[open_]
        while len(open_):
            met = self.codes[at] == g
            if fits is not None:
                met[met] = fits(open_[met], at[met])
            out[open_[met]] = at[met]
            at = at + 1
            more = np.flatnonzero(~met & (at < end))
            open_, at, end, g = open_[more], at[more], end[more], g[more]
        return out


#: What is known of a text before its n-grams that are not hot have met their weights.
_TOLD = "tokens:long,known:long,base:double,score:double"


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    The n-grams of a run of texts that are not hot meet their weights by ranges of hashes,
    like those that are counted. A range tells a run the sums of those of its texts that have
    n-grams there, so what is moved is bounded by the n-grams; a run adds the ranges' sums up.
    A run is known by its content, and rows are to come in the same order if read again, as
    they do from files. The ranges are met in 2^PASSES passes over the texts, and all but the
    last pass leave a table of sums, so that the n-grams of one pass are on the disks at a time.
    """
    docs = df.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    learned = F.col("id").isNotNull() & ~held_out("id")
    room, learned_room = docs.agg(*[F.coalesce(F.sum(F.when(c, F.octet_length("text"))), F.lit(0)) for c in (F.lit(True), learned)]).first()
    bits = max(0, (max(room, 1) - 1) // WEIGH_BYTES).bit_length()
    total, floor, weights = grow(docs.where(learned), "text", depth, learned_room, bits)
    hot = _slots(most_frequent(weights), floor)
    grams = weights.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    known_grams = bitmap(weights, grams, "grams", lambda blocks: np.frombuffer(b"".join(blocks.to_pylist()), np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast((*hot, known_grams))
    kind = docs.schema["id"].dataType
    told = f"array<struct<id:{kind.simpleString()},{_TOLD}>>"
    told_type = to_arrow_type(StructType.fromDDL(f"docs {told}")["docs"].dataType)
    never = float(np.log10(ALPHA / (floor or 1.0)))

    shift = min(PASSES, bits)
    passes = 1 << shift

    def deal(batches: Iterator[list[pa.Array]], turn: int) -> Iterator[list]:
        from xxhash import xxh3_128_digest

        hot_words, hot_grams, known_grams = sent.value
        mine = lambda g: g >> np.uint64(64 - shift) == turn if shift else np.ones(len(g), bool)
        for keys, idents, values in batches:
            for begin, end in runs(values, SCORE_BYTES):
                some = symbols(values.slice(begin, end - begin))
                owner, grams = some.owner, some.low
                texts = end - begin
                run = xxh3_128_digest(keys.slice(begin, texts).to_numpy().tobytes() + grams.tobytes())
                known, base, score = (np.zeros(texts) for _ in range(3))
                rows = []
                for size in range(1, depth + 2):
                    if size > 1:
                        grams = longer(grams)
                        may = owner[: len(grams)] == owner[size - 1 :]
                        if turn:
                            may &= mine(grams)
                            at = np.flatnonzero(may)
                            at = at[_may(known_grams, grams[at])]
                        else:
                            at = np.flatnonzero(may & _may(known_grams, grams))
                        hot, second = hot_grams, None
                    else:
                        at = some.inside()
                        at = at[mine(grams[at])] if turn else at
                        hot, second = hot_words, some.high[at]
                    g, of = grams[at], owner[at]
                    place, here = hot.places(g, second)
                    away = np.flatnonzero(~here if turn else ~here & mine(g))
                    rows.append((of[away].astype(np.uint16), g[away], *([] if second is None else [second[away]])))
                    if turn:  # the first pass tells what is known of hot ones
                        continue
                    here = np.flatnonzero(here)
                    place, to = place[here], of[here]
                    score += np.bincount(to, hot.weight[place], texts)
                    if size == 1:
                        known += np.bincount(to, minlength=texts)
                        base += np.bincount(to, hot.root[place], texts)
                words, others = rows[0], [np.concatenate(x) for x in zip(*rows[1:], strict=True)]
                one, two = dict(_ranged(bits, *words)), dict(_ranged(bits, *others))
                if turn:
                    ranges = sorted({*one, *two})
                    yield [[run] * len(ranges), ranges, [one.get(at, b"") for at in ranges], [two.get(at, b"") for at in ranges], pa.nulls(len(ranges), told_type)]
                    continue
                sizes = np.bincount(owner, minlength=texts) - 1
                ident = idents.slice(begin, texts).to_pylist()
                own = [dict(id=i, tokens=t, known=int(n), base=b, score=b + s) for i, t, n, b, s in zip(ident, *(x.tolist() for x in (sizes, known, base, score)), strict=True)]
                # the texts themselves go to some range of the first pass
                first = int.from_bytes(run[:8], "big") % ((1 << bits) // passes)
                ranges = sorted({first, *one, *two})
                yield [[run] * len(ranges), ranges, [one.get(at, b"") for at in ranges], [two.get(at, b"") for at in ranges], pa.array([own if at == first else None for at in ranges], told_type)]

    def weigh(texts: pa.Table, weights: pa.Table) -> pa.Table:
        one, two, three = (b"".join(weights[c].to_pylist()) for c in ("words", "grams", "adds"))
        (g, high, n, w), codes, weight = _table(one, *_WORDS), np.frombuffer(two, np.uint64), np.frombuffer(three)
        root, w, weight = np.r_[np.log10((n + ALPHA) / (floor or 1.0)), never], np.r_[w, 0.0], np.r_[weight, 0.0]
        words, grams = Index(g, bits), Index(codes, bits)
        sums = []
        for one, two in zip(texts["words"], texts["grams"], strict=True):
            some, of, wanted, second = _unranged(one.as_py(), 2)
            place = words.places(wanted, lambda i, at: high[at] == second[i])  # noqa: B023
            size = len(some)
            known = np.bincount(of[place < len(g)], minlength=size)
            base = np.bincount(of, root[place], size)
            score = np.bincount(of, root[place] + w[place], size)
            told = [np.array([size], np.uint32), some, known.astype(np.uint32), base, score]
            some, of, wanted = _unranged(two.as_py(), 1)
            if len(wanted):
                told += [some, np.bincount(of, weight[grams.places(wanted)], len(some))]
            sums.append(b"".join(x.tobytes() for x in told))
        return pa.Table.from_arrays([texts["run"], texts["docs"], pa.array(sums, pa.binary())], ["run", "docs", "sums"])

    def finish(parts: pa.Table) -> pa.Table:
        own = parts["docs"].drop_null()
        copies = len(own)  # runs of equal content are copies of each other
        own = own[0].values
        known, base, score = (np.zeros(len(own)) for _ in range(3))
        for block in parts["sums"]:
            block = block.as_py()
            size = int(np.frombuffer(block, np.uint32, 1)[0])
            of_words, of_grams = block[4 : 4 + 22 * size], block[4 + 22 * size :]
            some, *told = _columns(of_words, size, np.uint16, np.uint32, np.float64, np.float64)
            for to, x in zip((known, base, score), told, strict=True):
                to[some] += x / copies
            some, x = _columns(of_grams, len(of_grams) // 10, np.uint16, np.float64)
            score[some] += x / copies
        known, base, score = (own.field(c).to_numpy() + x for c, x in (("known", known), ("base", base), ("score", score)))
        out = pa.Table.from_arrays([own.field("id"), own.field("tokens"), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)], names)
        return pa.concat_tables([out] * copies)

    names = ["id", "n_tokens", "n_known", "base_score", "score"]
    read = docs.select(F.xxhash64("id", "text").alias("k"), "id", "text")
    parts = None
    for turn in range(passes):
        dealt = map_batches(read, ["k", "id", "text"], f"run binary, at long, words binary, grams binary, docs {told}", giving_back(partial(deal, turn=turn)))
        some = weights.drop("held", "top").where(F.floor(F.col("at") * passes / (1 << bits)) == turn)
        met = dealt.groupBy("at").cogroup(some.groupBy("at")).applyInArrow(weigh, f"run binary, docs {told}, sums binary")
        if turn < passes - 1:
            met = keep(met, "sums")
            del dealt
            release_shuffles(docs.sparkSession)
        parts = met if parts is None else parts.unionAll(met)
    sums = parts.groupBy("run").applyInArrow(finish, f"id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return sums.select(
        F.col("id").alias(key),
        held_out("id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def _ranged(bits: int, of: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, block) of n-grams, the first of the columns, and what goes with each: the number of
    texts, these, how many n-grams each has there, and the columns, by text."""
    at = (columns[0] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64) if bits else np.zeros(len(of), np.uint16)
    order = np.argsort(of, kind="stable")  # both of few bits, which NumPy sorts without comparing
    order = order[np.argsort(at[order], kind="stable")]
    at, of, *columns = (c[order] for c in (at, of, *columns))
    start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])][: len(at)])
    size = np.diff(np.r_[start, len(at)])
    parts = -(-size // MOST)  # a text with more n-grams than 16 bits tell is there more than once
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + MOST * step
    size = np.diff(np.r_[start, len(at)]).astype(np.uint16)
    text = of[start]
    full, first = np.unique(at, return_index=True)
    edges = np.r_[first, len(at)]
    entries = np.searchsorted(start, edges).tolist()
    edges = edges.tolist()
    for i, where in enumerate(full.tolist()):
        a, b = entries[i : i + 2]
        yield where, b"".join((np.uint32(b - a).tobytes(), text[a:b].tobytes(), size[a:b].tobytes(), *[c[edges[i] : edges[i + 1]].tobytes() for c in columns]))


def _unranged(block: bytes, columns: int) -> tuple[np.ndarray, ...]:
    """The distinct texts of a block, which of them each n-gram is of, and the columns of 64 bits."""
    entries = int(np.frombuffer(block, np.uint32, 1)[0]) if block else 0
    text, size = _columns(block[4 : 4 + 4 * entries], entries, np.uint16, np.uint16)
    rest = block[4 + 4 * entries :]
    some, at = np.unique(text, return_inverse=True)
    return some, np.repeat(at, size), *_columns(rest, len(rest) // (8 * columns), *[np.uint64] * columns)


def _columns(block: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    return [np.frombuffer(block, k, n, n * sum(sizes[:i])) for i, k in enumerate(kinds)]

"""Maximal periodic runs of words in texts, by tiles of one scale for each octave of periods.

A run is a stretch of words with smallest period q (words q apart are equal), as long as it
can be and of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods.

For the periods from D to 2D - 1, an octave, a text is cut into overlapping tiles around
boundaries D words apart: D words before a boundary and 3D after it. Two Z-functions of a
tile, of the words from the boundary on and of the words before it read backwards, tell for
each period how far equality reaches to both sides of the boundary: a fragment of the places
whose word equals the word a period later. A run has at least 3D such places, so it meets
fragments of D places and more at every boundary that it crosses, and these touch; shorter
ones are left out. The octaves below ``BASE`` share tiles in which each period's places are
found directly, as their own would be of a few words.

Fragments are shuffled by row and period, those that touch are stitched, and what is long
enough is a run, unless a divisor of its period gives the same run. A text goes through
its tiles where it is read; the tiles of one of more than ``LONG`` words are dealt out to
tasks of their own. Of the texts only those with a fragment are moved, to meet their runs.

A tile is skipped only where nothing can be lost: when no shift of the octave has half a
fragment on one side of the boundary (names of blocks of D/2 words, doubled from octave
to octave, tell this for all shifts at once; names are compared only to leave tiles out,
words decide), or when the whole tile is inside a run of a shorter period, as then each
fragment has a divisor of its period that gives the same run.

Defined results: a null text is empty and has no runs; so has a text of fewer words than
the least. Texts that repeat are judged each. An empty table stays empty. Long texts are
taken whole. Other columns stay, whatever their names; those named as an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowloom.llm.batches import SLICE_BYTES, map_batches, quoted, utf8
from flowloom.session import keep

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Periods below this are found without boundaries.
BASE = 16
#: Words of a text whose tiles are dealt out.
LONG = 1 << 17
#: Words of a shared tile of the lowest octaves.
SHARED = 1 << 16

Fragment = tuple[int, int, int]  # period, first place, end of the places


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Each word's number, the same for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def z_function(x: np.ndarray) -> np.ndarray:
    """For each shift the number of elements from there on that equal those from 0 on."""
    s = x.tolist()
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return np.array(z, np.int64)


def solve_tile(x: np.ndarray, at: int, d: int) -> list[Fragment]:
    """Fragments of the periods d to 2d - 1 in a tile ``x`` around its place ``at``, with
    places relative to ``at``; not those that a divisor of the period gives too."""
    shifts = np.arange(1, min(2 * d - 1, len(x) - at) + 1)
    if len(shifts) < d:
        return []
    ahead = np.append(z_function(x[at:]), 0)[shifts]
    # words before the boundary, backwards, against all words backwards from one shift later
    turned = x[::-1]
    back = z_function(np.concatenate([x[:at][::-1], [-1], turned]))
    before = np.minimum(back[at + 1 + len(x) - at - shifts], at) if at else np.zeros(len(shifts), np.int64)
    reach = np.minimum(ahead, d)
    found = shifts[(shifts >= d) & (np.minimum(before, d) + reach >= d)]
    if not len(found):
        return []
    lo, hi = before, ahead + shifts  # the stretch with period s is [-lo, hi)
    small = shifts[(shifts < d) & (lo + hi >= 2 * d)]
    while len(small) and len(found):
        g = int(small[0])
        same = (found % g == 0) & (lo[g - 1] >= np.minimum(lo[found - 1], d)) & (hi[g - 1] >= np.minimum(ahead[found - 1], d) + found)
        found = found[~same]
        small = small[1:]
        small = small[~((small % g == 0) & (lo[g - 1] >= lo[small - 1]) & (hi[g - 1] >= hi[small - 1]))]
    return [(int(q), -int(min(before[q - 1], d)), int(reach[q - 1])) for q in found]


def shared_tile(x: np.ndarray, places: int, first: bool, last: bool) -> list[Fragment]:
    """Fragments of the periods below BASE that begin in the first ``places`` words: stretches
    that are long enough, or touch an end of the tile beyond which the text goes on."""
    out = []
    for q in range(1, min(BASE, len(x))):
        n = min(places, len(x) - q)
        least = max(LEAST_WORDS, LEAST_PERIODS * q) - q
        same = x[:n] == x[q : q + n]
        # a stretch that is long enough has one of every `least` places
        if not same[least - 1 :: least].any() and (first or not same[0]) and (last or not same[-1]):
            continue
        cuts = np.flatnonzero(~same)
        starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [n]])
        some = (ends - starts >= least) | (ends > starts) & ((starts == 0) & (not first) | (ends == n) & (not last))
        out += [(q, int(a), int(b)) for a, b in zip(starts[some], ends[some], strict=True)]
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def boundaries(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(d, boundaries that may have a fragment) for each octave from BASE on that fits a text."""
    n = len(x)
    names, size = _mixed(x.astype(np.uint64), np.uint64(1)), 1
    d = BASE
    while d * LEAST_PERIODS <= n:
        while size < d // 2:  # names[i] is of the words i to i + size - 1
            names, size = _mixed(names[:-size], names[size:]), 2 * size
        rows = -(-n // d)
        grid = np.zeros((rows + 1) * d + size, np.uint64)
        known = np.zeros(len(grid), bool)
        grid[size : size + len(names)], known[size : size + len(names)] = names, True
        hits = np.zeros(rows, bool)
        for start in (size, 0):  # blocks that begin at a boundary, and those that end there
            g, k = (v[start : start + (rows + 1) * d].reshape(rows + 1, d) for v in (grid, known))
            hits |= ((g[1:] == g[:-1, :1]) & k[1:] & k[:-1, :1]).any(axis=1)
        yield d, np.flatnonzero(hits) * d
        d *= 2


def _touching(fragments: list[Fragment]) -> list[Fragment]:
    """Fragments of equal period that touch, as one."""
    out: list[Fragment] = []
    for q, a, b in sorted(fragments):
        if out and out[-1][0] == q and a <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((q, a, b))
    return out


def _long_enough(fragments: Iterable[Fragment]) -> list[tuple[int, int]]:
    return [(a, b + q) for q, a, b in fragments if b - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q)]


def fragments_of(x: np.ndarray) -> list[Fragment]:
    """All fragments of a text, tile by tile, octave by octave."""
    found = shared_tile(x, len(x), True, True)
    inside = _long_enough(found)
    for d, places in boundaries(x):
        own: list[Fragment] = []
        for c in places.tolist():
            a, b = max(0, c - d), min(len(x), c + 3 * d)
            if any(lo <= a and b <= hi for lo, hi in inside):
                continue
            own += [(q, c + i, c + j) for q, i, j in solve_tile(x[a:b], c - a, d)]
        own = _touching(own)
        inside += _long_enough(own)
        found += own
    return found


_FRAGMENTS = "array<struct<period:long,start:long,stop:long>>"
_FRAGMENT_TYPE = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))


def _as_structs(fragments: list[Fragment], offset: int = 0) -> list[dict]:
    return [{"period": q, "start": a + offset, "stop": b + offset} for q, a, b in fragments]


_ROWS = f"key {{}}, uid long, text string, fragments {_FRAGMENTS}, collapsed string, collapsed_sha256 string, d long, place long, at long, tile binary"


def _explode(with_texts: bool):
    """A row of each text (d null), with its fragments, and a row for each tile of long ones.

    A text without fragments is done: it collapses to its words. Others are kept.
    """

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for keys, uids, texts in batches:
            rows: list[tuple] = []  # place in the batch, text, fragments, collapsed, digest, and the tile
            size = 0

            def flush() -> list:
                nonlocal rows, size
                at, *made = zip(*rows, strict=True)
                rows, size = [], 0
                at = pa.array(at)
                fragments = pa.array(made[1], _FRAGMENT_TYPE)
                return [keys.take(at), uids.take(at), list(made[0]), fragments, *[list(m) for m in made[2:]]]

            for i, text in enumerate(utf8(texts)):
                words = text.split()
                x = numbers_of(words)
                whole = len(words) <= LONG
                found = fragments_of(x) if whole else []
                if whole and not found:
                    plain = b" ".join(words)
                    rows.append((i, None, [], plain.decode() if with_texts else None, hashlib.sha256(plain).hexdigest(), None, None, None, None))
                    size += len(plain) if with_texts else 200
                else:
                    rows.append((i, text.decode(), _as_structs(found), None, None, None, None, None, None))
                    size += len(text) + 40 * len(found)
                for d, c, at, tile in () if whole else _tiles(x):
                    if size + len(tile) > SLICE_BYTES and rows:
                        yield flush()
                    rows.append((i, None, [], None, None, d, c, at, tile))
                    size += len(tile)
                if size > SLICE_BYTES:
                    yield flush()
            if rows:
                yield flush()

    return run


def _tiles(x: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(d, place, place in the tile, words) of all tiles of a long text. The shared tiles have d = 0,
    and 1 instead of a place in the tile if the text ends in them."""
    for a in range(0, len(x), SHARED):
        yield 0, a, int(a + SHARED >= len(x)), x[a : a + SHARED + BASE - 1].tobytes()
    for d, places in boundaries(x):
        for c in places.tolist():
            a, b = max(0, c - d), min(len(x), c + 3 * d)
            yield d, c, c - a, x[a:b].tobytes()


def _solve(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
    for uid, ds, places, ats, tiles in batches:
        out = []
        for d, c, at, tile in zip(*(v.to_pylist() for v in (ds, places, ats, tiles)), strict=True):
            x = np.frombuffer(tile, np.int32)
            out.append(_as_structs(solve_tile(x, at, d) if d else shared_tile(x, SHARED, c == 0, bool(at)), c))
        yield [uid, pa.array(out, _FRAGMENT_TYPE)]


def stitched(fragments: DataFrame) -> DataFrame:
    """(uid, runs) from (uid, period, start, stop), shuffled by row and period."""
    by = W.partitionBy("uid", "period").orderBy("start", "stop")
    reached = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.when(reached >= F.col("start"), 0).otherwise(1))
    parts = parts.withColumn("part", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = parts.groupBy("uid", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    whole = whole.withColumn("length", F.col("stop") - F.col("start") + F.col("period"))
    whole = whole.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))
    smallest = whole.groupBy("uid", "start", "length").agg(F.min("period").alias("period"))
    return smallest.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapse(with_texts: bool):
    """The words of each text that stay, given its runs."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for keys, texts, runs in batches:
            plain = []
            for text, found in zip(utf8(texts), runs.to_pylist(), strict=True):
                words = text.split()
                stays = np.ones(len(words), bool)
                for r in found or ():
                    stays[r["start"] + r["period"] : r["start"] + r["length"]] = False
                plain.append(b" ".join([words[j] for j in np.flatnonzero(stays).tolist()]))
            yield [keys, runs, [p.decode() for p in plain] if with_texts else [None] * len(plain), [hashlib.sha256(p).hexdigest() for p in plain]]

    return run


_RUNS = "array<struct<start:long,period:long,length:long>>"


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", with_texts: bool = True) -> DataFrame:
    """Per row of ``df``: key, runs (start, period and length of each, by start and period),
    collapsed (if ``with_texts``; else null) and collapsed_sha256: the words, with one space
    between, less those that some run contains after its first period."""
    read = df.select(F.col(quoted(key)).alias("key"), F.monotonically_increasing_id().alias("uid"), F.col(quoted(text)).alias("text"))
    kind = read.schema["key"].dataType.simpleString()
    rows = keep(map_batches(read, ["key", "uid", "text"], _ROWS.format(kind), _explode(with_texts)), "tiles")
    tiles = rows.where("d is not null").select("uid", "d", "place", "at", "tile").repartition("uid", "d", "place")
    solved = map_batches(tiles, tiles.columns, f"uid long, fragments {_FRAGMENTS}", _solve)
    texts = rows.where("d is null")
    runs = stitched(texts.select("uid", F.inline("fragments")).unionByName(solved.select("uid", F.inline("fragments"))))
    open_ones = texts.where("text is not null").select("key", "uid", "text").join(runs, "uid", "left").drop("uid")
    shut = map_batches(open_ones, ["key", "text", "runs"], f"key {kind}, runs {_RUNS}, collapsed string, collapsed_sha256 string", _collapse(with_texts))
    done = texts.where("text is null").select("key", F.lit(None).cast(_RUNS).alias("runs"), "collapsed", "collapsed_sha256")
    both = done.unionByName(shut)
    return both.select(F.col("key").alias(key), F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"), "collapsed", "collapsed_sha256")


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns that sum up the rows of ``periodic_runs``: n_runs, the longest run and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    out = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return out.select(
        quoted(key),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def planted(text: Column, key: Column) -> Column:
    """The text with a periodic passage where 10 divides the key's CRC-32, else as it is."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def passage(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " "))

    # the one element of an array binds the words, which are so taken once
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0)))
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(words, passage), 0), text)).otherwise(text)

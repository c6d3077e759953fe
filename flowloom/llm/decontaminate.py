"""Benchmark decontamination with an Aho-Corasick automaton.

The test items are normalised to words, cut into windows of 13 words, and all distinct
windows go into one automaton, with a space at both ends so that only whole words
match. Each document is normalised the same way and scanned once. Normalising is a
byte-for-byte translation before the words are taken, so a matched word keeps its
offset in the original text.

The items are a stated query set that is sent to every task. Its size is checked: up
to ``AUTOMATON_BYTES`` of windows make one automaton; beyond it the items are taken in
blocks, each with a broadcast, an automaton and a scan of its own, and the hits of the
scans are merged row by row.

Null texts have no words. Items without words are in no document. Repeated rows each
get their row; an item_id that repeats counts once. Items
with a null item_id hit like all others; they count as one item, which has no name.
An empty table of documents stays empty, an empty benchmark hits nothing. Long texts are
scanned whole. Other columns stay, whatever their names; those named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import add_columns, quoted, utf8
from flowloom.session import keep

WINDOW = 13
#: Bytes of windows in one automaton (a node for each byte at most, about 50 bytes of memory each).
AUTOMATON_BYTES = 4 << 20
#: Scans after which the rows and their hits so far are written, if there are more blocks.
SCANS = 8

#: ASCII letters in lower case and digits stay, as do all bytes of other characters; the rest is space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in _FOLD)
_LOADED: dict[str, object] = {}


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def windows_of(data: bytes, size: int) -> list[bytes]:
    words = words_of(data)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))] if words else []


def _automaton(key: str, block: list[tuple[str, list[str | None]]]):
    """The automaton of a block, or None if it has no window; a worker keeps the last one."""
    import ahocorasick

    if key not in _LOADED:
        automaton = ahocorasick.Automaton()
        for window, items in block:
            automaton.add_word(window, (len(window), items))
        if len(automaton):
            automaton.make_automaton()
        _LOADED.clear()
        _LOADED[key] = automaton if len(automaton) else None
    return _LOADED[key]


def _scan(line: str, automaton) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Half-open spans of matched windows in a normalised line, and the items they are from."""
    spans, items = [], set()
    for end, (length, owners) in automaton.iter(line):
        spans.append((end - length + 2, end))  # without the space at either end
        items.update(owners)
    return spans, items


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple[str, list[str | None]]]]:
    """The distinct windows with their items, in blocks of bounded size; at least one.

    The driver holds a partition of the items and a block at a time.
    """
    owners: dict[bytes, dict[str | None, None]] = {}
    total = 0

    def block() -> list[tuple[str, list[str | None]]]:
        return [(w.decode("latin-1"), list(o)) for w, o in owners.items()]

    rows = benchmark.select(F.col(quoted(item)).cast("string").alias("i"), F.encode(F.col(quoted(text)).cast("string"), "UTF-8").alias("t")).dropna(subset=["t"])
    for row in rows.toLocalIterator():
        for w in windows_of(bytes(row.t), size):
            if w not in owners:
                if total + len(w) > AUTOMATON_BYTES and owners:
                    yield block()
                    owners.clear()
                    total = 0
                owners[w] = {}
                total += len(w)
            owners[w][row.i] = None
    yield block()


def _hits(raw: bytes, words: list[bytes], automaton) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Half-open ranges of hit words, and the items that hit them."""
    at, items = _scan((b" " + b" ".join(words) + b" ").decode("latin-1"), automaton) if words and automaton else ([], set())
    if not at:
        return [], set()
    begins = np.cumsum(np.r_[1, [len(w) + 1 for w in words]])[:-1]
    ends = np.searchsorted(begins, [b for _, b in at]).tolist()
    return list(zip(np.searchsorted(begins, [a for a, _ in at]).tolist(), ends, strict=True)), items


def mark_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, spans: bool = False) -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit if it lies inside any occurrence of a window; a document is
    contaminated if at least one word in twenty is hit. With ``spans`` there is also
    hits array<struct<start:int,end:int>>: the byte offsets, in the original text's
    UTF-8, of the stretches of hit words.
    """
    names = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    carried = [f"{what}_{uuid.uuid4().hex}" for what in ("ranges", "items")]  # no column of df
    blocks = benchmark_blocks(benchmark, item, item_text, size)
    block, out = next(blocks), df
    done = 0
    while (following := next(blocks, None)) is not None:
        if done and done % SCANS == 0:
            out = keep(out, "scanned")
        done += 1
        hand_on = f"{carried[0]} array<struct<a:int,b:int>>, {carried[1]} array<string>"
        out = _scan_block(out, text, block, carried if out is not df else [], hand_on, None)
        block = following
    out = _scan_block(out, text, block, carried if out is not df else [], names + ", hits array<struct<start:int,end:int>>" * spans, spans)
    return out.drop(*carried)


def _scan_block(df: DataFrame, text: str, block: list[tuple[str, list[str | None]]], earlier: list[str], outputs: str, spans: bool | None) -> DataFrame:
    """Scan with the automaton of one block. ``earlier``: the columns of earlier blocks' hits.
    ``spans`` None: hand the hits on; else sum them up."""
    sent, key = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        for texts, *found in batches:
            automaton = _automaton(key, sent.value)
            old = [x.to_pylist() for x in found] or None
            rows = []
            for i, raw in enumerate(utf8(texts)):
                words = words_of(raw)
                ranges, items = _hits(raw, words, automaton)
                if old:
                    ranges += [(r["a"], r["b"]) for r in old[0][i]]
                    items = items.union(old[1][i])
                rows.append(([{"a": a, "b": b} for a, b in ranges], list(items)) if spans is None else _sum_up(raw, words, ranges, items, spans))
            yield [list(c) for c in zip(*rows, strict=True)] if rows else _none(outputs)

    return add_columns(df, [text, *earlier], outputs, run)


def _none(outputs: str) -> list[list]:
    from pyspark.sql.types import StructType

    return [[] for _ in StructType.fromDDL(outputs)]


def _sum_up(raw: bytes, words: list[bytes], ranges: list[tuple[int, int]], items: set[str | None], spans: bool) -> tuple:
    if not ranges:
        return (len(words), 0, 0, EMPTY, False, *[[]] * spans)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [a for a, _ in ranges], 1)
    np.add.at(edge, [b for _, b in ranges], -1)
    hit = np.cumsum(edge[:-1]) > 0
    n = int(hit.sum())
    digest = hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()
    return (len(words), n, len(items), digest, 20 * n >= len(words), *[_stretches(raw, hit)] * spans)


#: The digest of no items.
EMPTY = hashlib.sha256(b"").hexdigest()


def _stretches(raw: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    out: list[dict[str, int]] = []
    for i in np.flatnonzero(hit).tolist():
        if i and hit[i - 1]:
            out[-1]["end"] = places[i][1]
        else:
            out.append({"start": places[i][0], "end": places[i][1]})
    return out


#: The same rows from windows that are joined as text.
ORACLE = r"""
with split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 13) as size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as line
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)),
places as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as line
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from split) p join (select distinct size from windows) s on p.i + s.size - 1 <= len(p.w)),
found as (select doc_id, i, p.size, item_id from places p join windows using (size, line)),
hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + size)) as place from found) group by doc_id),
owners as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from split left join hits using (doc_id) left join owners using (doc_id)
"""

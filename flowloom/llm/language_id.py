"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An n-gram's
vector binds (multiplies) those of its letters, each rotated by its place. A text's
vector bundles (adds) the vectors of its n-grams, a language's prototype those of all
its training texts; a text gets the language whose prototype has the largest cosine.

Letters are folded to lower case; whatever is not a letter is one boundary symbol, and
a text has one at both ends. A null text, or one without a letter, is ``und`` with
score 0, as is every text if nothing could be learned. Ties go to the name that sorts first.
Repeated rows each get their row, and are learned from each. An empty table stays empty. Long
texts are taken whole. Other columns stay, whatever their names; those named as an output are
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import add_columns, map_batches, quoted, slices

DIMENSIONS = 512
N = 3
#: n-grams of which a worker keeps the vectors (512 bytes each); beyond it starts afresh.
KEPT = 30_000
#: Languages whose prototypes are sent to every task at once, 2 KB each; more take more scans.
LANGUAGES = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point that of its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct n-grams as 63-bit numbers, their counts, and whether there is a letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    codes = np.r_[0, codes, 0]
    keep = (codes[1:] != 0) | (codes[:-1] != 0)  # one boundary for a run of other characters
    codes = np.r_[codes[:1], codes[1:][keep]]
    if not codes.any():
        return codes[:0], codes[:0], False
    codes = codes[: len(codes)] if len(codes) >= N else np.r_[codes, np.zeros(N - len(codes), np.int64)]
    keys = codes[: len(codes) - N + 1].copy()
    for k in range(1, N):
        keys = keys << 21 | codes[k : len(codes) - N + 1 + k]
    found, counts = np.unique(keys, return_counts=True)
    return found, counts, True


@lru_cache(maxsize=8_192)
def _letter(code: int, place: int) -> np.ndarray:
    base = np.random.default_rng([code, 20_240]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return np.roll(base, place).astype(np.int8)


class Memory:
    """The vectors of n-grams met so far."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, DIMENSIONS), np.int8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(keys) > KEPT:
            self.rows.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.r_[self.vectors, np.empty_like(self.vectors)]
                vector = _letter(key & 0x1FFFFF, 0)
                for place in range(1, N):
                    vector = vector * _letter(key >> 21 * place & 0x1FFFFF, place)
                self.vectors[row] = vector
            out[i] = row
        return self.vectors[out]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS, np.float32)
        for i in range(0, len(keys), 8192):
            total += counts[i : i + 8192].astype(np.float32) @ self.of(keys[i : i + 8192]).astype(np.float32)
        return total


@lru_cache(maxsize=1)
def _memory() -> Memory:
    return Memory()


def learn_profiles(df: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each label: the sum of the n-gram vectors of its texts, of length 1.

    Tasks count n-grams and add their vectors; only sums for each label leave them.
    """

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        sums: dict[str, np.ndarray] = {}
        for texts, labels in batches:
            groups: dict[str, list[str]] = {}
            for t, name in zip(texts.to_pylist(), labels.to_pylist(), strict=True):
                if t and name is not None:
                    groups.setdefault(name, []).append(t)
            for name, some in groups.items():
                for part in slices(some, most=1 << 20):
                    keys, counts, any_letter = grams("\n".join(part))
                    if any_letter:
                        sums[name] = sums.get(name, 0) + _memory().bundle(keys, counts).astype(np.float64)
        names = list(sums)
        yield [[x for x in names for _ in range(DIMENSIONS)], np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(names)), np.concatenate([np.empty(0), *[np.rint(sums[x]) for x in names]]).astype(np.int64)]

    parts = map_batches(df.where(F.col(quoted(label)).isNotNull()), [text, label], "name string, place int, total long", run)
    whole = parts.groupBy("name", "place").agg(F.sum("total").alias("total")).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("place", "total")))["total"].alias("vector"))
    out = {}
    for row in whole.orderBy("name").toLocalIterator():
        vector = np.array(row["vector"], np.float64)
        if (length := np.sqrt(vector @ vector)) > 0:
            out[row["name"]] = vector / length
    return out


def identify(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (the cosine, 0 at least)."""
    names = sorted(profiles)
    if len(names) > LANGUAGES:
        left, right = (uuid.uuid4().hex for _ in range(2))
        first = identify(df, {x: profiles[x] for x in names[:LANGUAGES]}, text)
        both = identify(first.withColumnsRenamed({"lang_pred": left, "score": right}), {x: profiles[x] for x in names[LANGUAGES:]}, text)
        better = (F.col("score") > F.col(right)) | (F.col(left) == "und")
        return both.withColumns({"lang_pred": F.when(better, F.col("lang_pred")).otherwise(F.col(left)), "score": F.greatest("score", right)}).drop(left, right)
    matrix = np.array([profiles[x] for x in names], np.float64).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list]:
        memory = _memory()
        for (texts,) in batches:
            predictions, scores = [], []
            for t in texts.to_pylist():
                keys, counts, any_letter = grams(t or "")
                if not any_letter or not names:
                    predictions.append("und")
                    scores.append(0.0)
                    continue
                vector = memory.bundle(keys, counts).astype(np.float64)
                near = np.round(matrix @ vector / max(float(np.sqrt(vector @ vector)), 1e-9), 9)  # what is closer is a tie
                best = int(np.argmax(near))
                predictions.append(names[best])
                scores.append(min(1.0, max(0.0, float(near[best]))))
            yield [predictions, scores]

    return add_columns(df, [text], "lang_pred string, score double", run)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_and_identify(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``df`` with held_out, lang_pred and score; learned from the rows that are not held out."""
    profiles = learn_profiles(df.where(~held_out(key)).select(quoted(text), quoted(label)), text, label)
    return identify(df, profiles, text).withColumn("held_out", held_out(key))

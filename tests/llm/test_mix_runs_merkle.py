"""Mixing, periodic runs and the manifest against brute force, and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import DATA, difference, duck
from pyspark.sql import functions as F

from flowloom.llm import merkle, mixing, periodic_runs as pr
from flowloom.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- runs ---------------------------------------------------------------------


def brute_runs(words):
    """Every maximal stretch of each period, tried word by word."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def random_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < rng.choice((0, 5, 40, 300, 900)):
            kind = rng.random()
            block = [rng.choice("ab" if kind < 0.3 else "abcdefghijklmnop") for _ in range(rng.choice((1, 2, 3, 7, 15, 16, 17, 31, 33, 64, 100)))]
            words += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))] if kind < 0.8 else [rng.choice("abcdefgh")]
        if words and rng.random() < 0.3:
            words = (words * 40)[: rng.randint(len(words), 1500)]
        yield words[:1500]


def whole(fragments):
    """Runs of one text from its fragments, without Spark."""
    found = {}
    for q, a, b in pr._touching(list(fragments)):
        length = b - a + q
        if length >= max(6, 4 * q):
            found[a, length] = min(q, found.get((a, length), q))
    return sorted((s, q, length) for (s, length), q in found.items())


def test_fragments_make_the_runs_of_brute_force():
    for words in random_texts(1, 150):
        x = pr.numbers_of([w.encode() for w in words])
        assert whole(pr.fragments_of(x)) == brute_runs(words)


def test_tiles_that_are_dealt_out_make_the_same_runs(monkeypatch):
    monkeypatch.setattr(pr, "SHARED", 37)
    for words in random_texts(2, 80):
        x = pr.numbers_of([w.encode() for w in words])
        made = []
        for d, c, at, tile in pr._tiles(x):
            part = np.frombuffer(tile, np.int32)
            made += [(q, c + a, c + b) for q, a, b in (pr.solve_tile(part, at, d) if d else pr.shared_tile(part, 37, c == 0, bool(at)))]
        assert whole(made) == brute_runs(words)


def test_z_function():
    rng = random.Random(3)
    for _ in range(60):
        x = [rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        want = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert pr.z_function(np.array(x)).tolist() == want


def plan(text, doc_id):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_runs(text, doc_id):
    words = plan(text, doc_id)
    runs = brute_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    s, q, length = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def digests(spark, docs):
    docs = docs.withColumn("text", pr.planted(F.col("text"), F.col("doc_id")))
    rows = pr.run_digests(pr.periodic_runs(docs, with_texts=False)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_run_query_against_brute_force(spark, monkeypatch):
    docs = table(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").where("length(text) < 6000")
    want = sorted(((r["doc_id"], *expected_runs(r["text"], r["doc_id"])) for r in docs.collect()), key=repr)
    assert digests(spark, docs) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_on_odd_input(spark):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a a a a a"), (6, "a a a a a a"), (6, "a a a a a a"), (None, "x y x y x y x y x"), (7, "é é é é " * 4), (planted, ""), (planted, None), (planted, "one"), (8, "a b " * 5000 + "c " * 7), (9, "w" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.lit(5), "runs": F.lit("mine"), "collapsed": F.lit(1)})
    assert digests(spark, docs) == sorted(((k, *expected_runs(t, k)) for k, t in rows), key=repr)
    assert digests(spark, docs.limit(0)) == []
    texts = {r["doc_id"]: r["collapsed"] for r in pr.periodic_runs(docs.where("doc_id in (5, 6, 8)")).collect()}
    assert texts == {5: "a a a a a", 6: "a", 8: "a b c"}


def test_long_texts_go_through_tiles_of_their_own(spark):
    rng = random.Random(4)
    noise = [str(rng.randint(0, 10**6)) for _ in range(40_000)]
    words = noise + ["q"] * 200 + noise * 4 + ["r", "s", "t"] * 30_000
    assert len(words) > pr.LONG
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "no run here")], "doc_id long, text string")
    rows = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in pr.periodic_runs(docs).collect()}
    assert rows == {1: [(40_000, 1, 200), (40_200, 40_000, 160_000), (200_200, 3, 90_000)], 2: []}


# --- mixing -------------------------------------------------------------------


def brute_mix(rows):
    """Targets capped round by round, queues merged one entry after another; (doc_id, target, taken)."""
    size = lambda t: len((t or "").encode().split())
    total, own = sum(size(t) for *_, t in rows), {}
    for _, s, t in rows:
        own[s] = own.get(s, 0) + size(t)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        left = total - sum(3 * own[s] for s in capped)
        share = left / (sum(weight[s] for s in own if s not in capped) or 1)
        more = {s for s in own if s not in capped and share * weight[s] > 3 * own[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * own[s] if s in capped else share * weight[s] for s in own}
    place = lambda k, t: hashlib.md5(str(k).encode()).hexdigest()[:15]
    entries = []
    for s in own:
        queue = sorted((place(k, t), k, i) for i, (k, source, t) in enumerate(rows) if source == s and size(t))
        passed = 0
        for epoch in range(3):
            for _, _, i in queue:
                passed += size(rows[i][2])
                entries.append((passed / target[s], "" if s is None else "=" + s, passed, i))
    taken, room = [0] * len(rows), total
    for *_, i in sorted(entries):
        words = min(room, size(rows[i][2]))
        taken[i] += words
        room -= words
    return sorted((k, size(t), own[s], round(target[s], 6), taken[i]) for i, (k, s, t) in enumerate(rows))


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"uid": F.lit("mine"), "size": F.lit(1), "queue": F.lit(2)})
    out = [(r["doc_id"], r["size"], r["source_size"], round(r["target"] or 0.0, 6), r["taken"]) for r in mixing.mixed_words(docs).collect()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_brute_force(spark, seed):
    rng = random.Random(seed)
    sources = ["é", "z", "a", None, "lone"]
    rows = [(i, rng.choice(sources[:4]), "w " * rng.choice((0, 1, 7, 30, 400))) for i in range(200)] + [(999, "lone", "one   two\tthree")]
    assert mixed(spark, rows) == sorted(brute_mix(rows), key=repr)


def test_mix_on_odd_input(spark):
    assert mixed(spark, []) == []
    nothing = mixed(spark, [(1, "a", None), (2, None, ""), (None, "a", " ")])
    assert sorted(r[1:] for r in nothing) == [(0, 0, 0.0, 0)] * 3
    rows = [(1, "a", "x y z")] * 3 + [(None, None, "k"), (None, None, "k"), (5, "b", "w " * 5000)]
    got = mixed(spark, rows)
    assert len(got) == 6 and sum(r[4] for r in got) == 9 + 2 + 5000
    assert all(r[4] <= 3 * r[1] for r in got)


def test_mix_keeps_to_targets_and_to_itself_on_a_rerun(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    stream = mixing.mix(mixing.queued(docs, carry=("text",)))
    rows = stream.select("key", "source", "target", "epoch", "finish", "taken", "size", "carry.text").collect()
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["target"]), []).append(r)
    longest = max(r["size"] for r in rows)
    assert all(abs(sum(r["taken"] for r in some) - target) <= longest for (_, target), some in by.items())
    assert all(len((r["text"] or "").encode().split()) == r["size"] for r in rows)
    again = mixing.mix(mixing.queued(docs.repartition(7))).select("key", "epoch", "finish", "taken").collect()
    assert sorted(tuple(r) for r in again) == sorted((r["key"], r["epoch"], r["finish"], r["taken"]) for r in rows)


def test_the_mix_is_native(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    plan = mixing.mixed_words(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "MapIn", "ExistingRDD"))


# --- manifest -----------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(row, at):
    """(root, proof parts) of a row of digests, and what the root is with another digest at a place."""
    proof, place = [], at
    while len(row) > 1:
        run = row[place // 16 * 16 : place // 16 * 16 + 16]
        proof += run[: place % 16] + run[place % 16 + 1 :]
        row = [sha(*row[i : i + 16]) for i in range(0, len(row), 16)]
        place //= 16
    return row[0], proof


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
        subroots.append(climb([x[2] for x in trees[s]], 0)[0])
    out = []
    for i, s in enumerate(order):
        leaves = [x[2] for x in trees[s]]
        for at, (*_, own, r) in enumerate(trees[s]):
            subroot, proof = climb(leaves, at)
            root, more = climb(subroots, i)
            changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            other = leaf(r, r[1].translate(lower)) if changed else own
            low = climb([*leaves[:at], other, *leaves[at + 1 :]], at)[0]
            folded = climb([*subroots[:i], low, *subroots[i + 1 :]], i)[0]
            out.append((r[0], own, subroot, root, sha(*proof, *more), folded, folded == root))
    return sorted(out, key=repr)


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit("mine"), "pos": F.lit(1), "leaf": F.lit(2)})
    return sorted((tuple(r) for r in merkle.manifest(docs, changes={"text": merkle.tampered_text()}).collect()), key=repr)


def test_manifest_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    sizes = {"a": 1, "b": 16, "c": 17, "é": 257, None: 3, "z": 40}
    rows = [(i, f"Text {i}" if i % 9 else None, None if i % 4 else "fr", s, i if i % 3 else None) for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    rows += [(i + 10_000, "T é X", "en", f"lone{i}", 5) for i in range(20)]
    rng.shuffle(rows)
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_over_blocks(spark):
    rows = [(i, f"T{i}", None, "s" if i < 4099 else "t", None) for i in range(4110)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_on_odd_input(spark):
    assert manifest(spark, []) == []
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (2, "", "", "", 0), (3, "X" * 300_000, "en", "s", 9)]
    assert manifest(spark, rows) == brute_manifest(rows)
    assert manifest(spark, rows[:1]) == brute_manifest(rows[:1])


def test_a_slot_is_folded_from_its_own_state():
    children = [sha(str(i)).encode() for i in range(16)]
    parent = merkle.Parent(list(children))
    for slot in range(16):
        other = [*children[:slot], sha("new").encode(), *children[slot + 1 :]]
        assert parent.folded(slot, other[slot]) == merkle.Parent(other).digest
        parent.children[slot] = b"gone"  # what is left of a later slot is not read again


@pytest.mark.parametrize("name", ["op11_mixing", "op13_merkle"])
def test_sql_twins_of_larger_tables(spark, name):
    from flowloom.llm.queries import ORACLES, QUERIES

    sf = f"{DATA}/sf0.01"
    assert difference(QUERIES[name](spark, sf).toPandas(), duck(sf).sql(ORACLES[name]).df()) == ""

"""Near-duplicates, decontamination, language ID and the pipeline against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from flowloom.llm import decontaminate, language_id, simhash, wide_simhash
from flowloom.llm.components import connected
from flowloom.llm.decontaminate import mark_contamination
from flowloom.llm.language_id import train_and_identify
from flowloom.llm.simhash import anchors_of, forest, links_in_groups, near_duplicate_groups, simhashes
from flowloom.session import table

SMALL = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, prints, most=4):
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    return [min(groups[find(i)]) for i in range(len(keys))]


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_anchors_meet_within_four_bits(layout):
    rng = np.random.default_rng(5)
    one = rng.integers(-(2**63), 2**63 - 1, 500)
    other = one.view(np.uint64).copy()
    for i in range(500):
        for b in rng.choice(64, i % 5, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    sets = [[set() for _ in one], [set() for _ in one]]
    for k, values in enumerate((one, other.view(np.int64))):
        for block, anchors, rows in anchors_of(values, layout):
            for a, r in zip(anchors.tolist(), rows.tolist(), strict=True):
                sets[k][r].add((block, a))
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_forest_and_small_groups_agree():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**60, 12)
    values = np.unique(np.concatenate([base ^ (1 << rng.integers(0, 60)) ^ (1 << rng.integers(0, 60)) for _ in range(12)]))
    parts = [forest(values), links_in_groups(np.zeros(min(60, len(values)), np.int64), values[:60])]
    for (left, right), some in zip(parts, (values, values[:60]), strict=True):
        want = brute_components(some.tolist(), some.tolist())
        groups = {v: v for v in some.tolist()}
        for _ in range(20):
            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                groups[a] = groups[b] = min(groups[a], groups[b])
        assert [groups[v] for v in some.tolist()] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 5), (200, 201), (201, 200), (7, 7), (None, 3)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.u: r.v for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200, **{300 + i: 300 for i in range(1, 50)}}


def test_components_of_nothing(spark):
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_of_documents(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    got = near_duplicate_groups(docs).orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in docs.orderBy("doc_id").collect()]
    assert [r.fingerprint & (2**64 - 1) for r in got] == prints
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in got], prints)


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_links_of_each_layout(spark, layout):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    values = np.concatenate([base, *[base ^ np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 63, (k, 60)), axis=0) for k in (1, 2, 3, 4, 5, 6)]])
    values = np.unique(values).tolist()
    got = connected(simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), layout)).collect()
    root = {r.u: r.v for r in got}
    want = brute_components(values, [v & (2**64 - 1) for v in values])
    assert [root.get(v, v) for v in values] == want


def test_layouts_by_number():
    few, many = simhash.LAYOUTS
    assert few.work(10**6) < many.work(10**6) and few.work(10**9) > many.work(10**9)


def test_simhash_beside_columns_of_any_name(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    odd = docs.selectExpr("doc_id as `a``b`", "text as key", "1 as fingerprint", "map(1, 2) as component_id", "3 as first")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(near_duplicate_groups(odd, "a`b", "key")) == rows(near_duplicate_groups(docs))


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "one two"), (2, "ONE  two"), (2, "ONE  two"), (7, "x " * 30_000), (8, "É é")]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 3), (5, 3), (7, 7), (8, 8), (9, 3)]
    assert simhashes([b"", b" "]).tolist() == [0, 0]
    assert near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_anchors_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    near = [(1000 + i, " ".join(words * 20 + [f"tail{i}"])) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = near_duplicate_groups(both).orderBy("doc_id").collect()
    prints = [r.fingerprint & (2**64 - 1) for r in got]
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in got], prints)


def brute_wide(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    rest, out = 2**64 - 1, 0
    for k in range(4):
        hashes = [xxh64_intdigest(p.encode(), seed=42) for p in parts]
        if k:
            hashes = [h + k * 0x9E3779B97F4A7C15 & rest for h in hashes]
            hashes = [(h ^ h >> 30) * 0xBF58476D1CE4E5B9 & rest for h in hashes]
            hashes = [(h ^ h >> 27) * 0x94D049BB133111EB & rest for h in hashes]
            hashes = [h ^ h >> 31 for h in hashes]
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << 64 * k
    return out


def test_wide_simhashes(monkeypatch):
    texts = ["", " ", "one two", "a b c d e f", "word " * 40, " ".join(str(i % 37) for i in range(3000)), "É é x y z w"]
    monkeypatch.setattr(wide_simhash, "AT_ONCE", 64)
    got = wide_simhash.wide_simhashes([t.encode() for t in texts])
    assert [sum(int(x) << 64 * i for i, x in enumerate(r)) for r in got] == [brute_wide(t) for t in texts]


def test_words_within_two_bits_of_a_block_meet():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 300).astype(np.uint64)
    other = one.copy()
    for i in range(300):
        for b in rng.choice(24, i % 3, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    sets = [[set() for _ in one] for _ in range(2)]
    for k, values in enumerate((one, other)):
        for block, anchors, rows in anchors_of(values.view(np.int64), wide_simhash.BANDS):
            for a, r in zip(anchors.tolist(), rows.tolist(), strict=True):
                if not block:
                    sets[k][r].add(a)
    assert all(a & b for a, b in zip(*sets, strict=True))


@pytest.mark.parametrize("most", [wide_simhash.FEW, 3])
def test_wide_links_at_an_anchor(monkeypatch, most):
    monkeypatch.setattr(wide_simhash, "FEW", most)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (8, 4)).astype(np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, (8, 4)).astype(np.uint64)) for _ in range(12)]), axis=0)
    keys = np.sort(rng.integers(0, 4, len(values)))
    got = wide_simhash.links_in_groups(keys, values)
    ints = [sum(int(x) << 64 * i for i, x in enumerate(r)) for r in values]
    root = list(range(len(values)))
    for _ in range(20):
        for a, b in zip(*(x.tolist() for x in got), strict=True):
            root[a] = root[b] = min(root[a], root[b])
    for key in range(4):
        some = np.flatnonzero(keys == key).tolist()
        assert [root[i] for i in some] == brute_components(some, [ints[i] for i in some], wide_simhash.NEAR)


@pytest.mark.parametrize("chunk", [wide_simhash.CHUNK, 4])
def test_copies_of_a_similarity_of_four_fifths(spark, monkeypatch, chunk):
    """Copies whose sets of five-word shingles share 0.8 to 1: nine in ten are found; others stay alone."""
    monkeypatch.setattr(wide_simhash, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    rows, near = [], {}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        copy = list(words)
        for at in rng.choice(len(words), int(rng.integers(0, max(1, len(words) // 40) + 1)), replace=False):
            copy[at] = f"n{at}"
        a, b = shingles(words), shingles(copy)
        near[i] = len(a & b) / len(a | b)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in near) and all(got[1000 + i] in (i, 1000 + i) for i in near)
    asked = [i for i, s in near.items() if s >= 0.8]
    assert len(asked) > 150 and sum(got[1000 + i] == i for i in asked) >= 0.9 * len(asked)
    assert all(got[1000 + i] == i for i, s in near.items() if s == 1)
    assert not any(got[1000 + i] == i for i, s in near.items() if s < 0.5)


def test_links_of_near_copies_grow_with_a_group_not_its_square(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))) for i in range(20)]
    for i in range(100, 700):
        copy = list(words)
        copy[int(rng.integers(0, 300))] = f"n{i}"
        rows.append((i, " ".join(copy)))
    edges = []
    plain = wide_simhash.connected
    monkeypatch.setattr(wide_simhash, "connected", lambda links: edges.append(links.count()) or plain(links))
    got = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 100 if i >= 100 else i for i, _ in rows}
    assert max(edges) < 10 * len(rows)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, size=13):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    hit, owners = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i : i + size]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    owners.add(str(item))
    return len(words), len(hit), owners, [words[i] for i in sorted(hit)]


@pytest.mark.parametrize("block", [1 << 22, 6_000])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr("flowloom.llm.decontaminate.AUTOMATON_BYTES", block)
    docs = [r.asDict() for r in table(spark, SMALL, "documents").select("doc_id", "text").limit(80).collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    items += [(900, "Short é item"), (901, None), (902, "...!"), (903, "short É item"), (900, "Short é item")]
    docs += [{"doc_id": 500 + i, "text": t} for i, t in enumerate((None, "", "--", items[0][1], "x " * 400 + items[1][1], "a SHORT-é\titem b", "short é items", items[2][1].upper() * 3, "y" * 100_000))]
    rows = mark_contamination(spark.createDataFrame([(d["doc_id"], d["text"], True) for d in docs], "doc_id long, text string, contaminated boolean"), spark.createDataFrame(items, "item_id long, text string"), spans=True).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hits, owners, words = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hits, len(owners)), r.doc_id
        assert r.contaminated == (hits > 0 and 20 * hits >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        raw = (r.text or "").encode()
        assert [w for s in r.hits for w in WORD.findall(raw[s.start : s.end].decode().translate(ASCII_LOWER))] == words


@pytest.mark.parametrize("block", [1 << 22, 10])
def test_items_without_an_id_hit_as_in_sql(spark, monkeypatch, block):
    monkeypatch.setattr("flowloom.llm.decontaminate.AUTOMATON_BYTES", block)
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three four five"), (3, "six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (7, "four five"), (None, "four"), (8, None), (None, None)], "item_id long, text string")
    got = mark_contamination(docs, items).drop("text").toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("items", items.selectExpr("cast(item_id as string) as item_id", "text").toPandas())
    con.sql("create view benchmark as select item_id::bigint as item_id, text from items")
    want = con.sql(decontaminate.ORACLE).df().sort_values("doc_id")
    assert got[want.columns].values.tolist() == want.values.tolist()
    assert got.contaminated.tolist() == [True, True, False]


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert mark_contamination(docs, none).collect()[0].n_words == 2
    assert mark_contamination(docs.where("false"), none).count() == 0


def test_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rows = train_and_identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    known = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 6)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 --", "en"), (103, "the", None), (104, "und " * 50_000, None), (None, "the dog", "en"), (103, "the", None), (105, "a", None)]
    rows = {(r.doc_id, r.text): r for r in train_and_identify(spark.createDataFrame(known + odd, "doc_id long, text string, lang string")).collect()}
    assert [rows[k].lang_pred for k in ((100, None), (101, ""), (102, "123 --"))] == ["und"] * 3
    assert rows[103, "the"].lang_pred == "en" and rows[104, "und " * 50_000].lang_pred == "de"
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert train_and_identify(none).collect()[0].lang_pred == "und"
    assert train_and_identify(none.where("false")).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    rows = [r for r in docs.orderBy("doc_id").collect() if r.text and any(c.isalpha() for c in r.text)]
    prints = [brute_wide(r.text) for r in rows]
    first = brute_components([r.doc_id for r in rows], prints, wide_simhash.NEAR)
    kept = [r for r, c in zip(rows, first, strict=True) if r.doc_id == c]
    clean = [r.doc_id for r in kept if not ((h := brute_hits(r.text, items))[1] and 20 * h[1] >= h[0])]
    out = corpus_pipeline.run(spark, SMALL)
    got = out.orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == clean and len(clean) < len(kept) < len(rows)
    assert out.columns == [*docs.columns, "ids", "n_tokens"] and all(len(r.ids) == r.n_tokens for r in got)


def test_stages_keep_columns_of_any_name_and_kind(spark):
    rows = [(1, "the cat sat on the mat", "en", {"a": 1}, None, 2), (1, "the cat sat on the mat", "en", {"a": 1}, 2, None), (2, "a dog ran out of the old house in the rain", "en", None, 1, 1), (None, None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, `m``ap` map<string,int>, __key__ int, __ranges int"
    docs = spark.createDataFrame(rows, kinds).selectExpr("*", "1 as __items", "array(2) as `x.y`", "3 as fingerprint", "4 as key", "5 as contaminated", "6 as LANG_PRED", "7 as component_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns[: len(docs.columns)] == docs.columns
        left = sorted(str(r.doc_id) for r in out.collect())
        assert left == {"language_id": ["1", "1", "2"], "simhash_dedup": ["1", "2", "None"]}.get(name, ["1", "1", "2", "None"])


def test_benchmark_in_blocks_beside_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr("flowloom.llm.decontaminate.AUTOMATON_BYTES", 200)
    docs = table(spark, SMALL, "documents").select("doc_id", "text").limit(50)
    odd = docs.selectExpr("doc_id", "text as `t``x`", "1 as __ranges", "2 as __items", "3 as n_hit")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "items_sha256").collect()))
    benchmark = table(spark, SMALL, "benchmark").limit(10)
    got = mark_contamination(odd, benchmark, "t`x")
    assert rows(got) == rows(mark_contamination(docs, benchmark)) and {"__ranges", "__items"} <= set(got.columns)


def plain_vector(text):
    """Letter by letter: each of three letters' random signs turned by its place, multiplied, and added up."""
    symbols = [0]
    for c in f"{text} ":
        symbol = ord(c.lower()) if c.isalpha() else 0
        if symbol or symbols[-1]:
            symbols.append(symbol)
    total = np.zeros(512)
    for gram in zip(symbols, symbols[1:], symbols[2:]):
        product = np.ones(512)
        for place, symbol in enumerate(reversed(gram)):
            signs = np.random.default_rng([symbol, 20_240]).integers(0, 2, 512, dtype=np.int8) * 2.0 - 1
            product *= np.concatenate([signs[512 - place :], signs[: 512 - place]])
        total += product
    return total


def test_languages_by_a_plain_profile(spark):
    rows = [(i, f"{w} the sea {i}", "en") for i, w in enumerate(("cat", "dog", "hen"))] + [(10 + i, f"{w} das Meer {i}", "de") for i, w in enumerate(("Hund", "Huhn", "Kuh"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in train_and_identify(docs).collect()}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sums = {}
    for _, text, lang in learned:
        sums[lang] = sums.get(lang, 0) + plain_vector(text)
    for key, text, _ in rows:
        v = plain_vector(text)
        near = {x: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for x, s in sums.items()}
        assert got[key].lang_pred == max(sorted(near), key=near.get)
        assert got[key].score == pytest.approx(max(near.values()), abs=0.02)


def test_equal_cosines_and_many_languages(spark, monkeypatch):
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:7]
    docs = spark.createDataFrame([(i, "one text", f"l0{k}") for k, i in enumerate(learned)] + [(99, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in train_and_identify(docs).collect()} == {"l00", "und"}
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert {r.lang_pred for r in train_and_identify(docs).collect()} == {"l00", "und"}


def test_stages_keep_columns_and_bear_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en", "s", 22, 0.5, "mine"), (1, "the cat sat on the mat", "en", "s", 22, 0.5, "mine"), (2, None, None, None, None, None, None), (None, "a null id here", "en", "s", 3, None, "x"), (4, "THE CAT sat on the mat", "en", "s", 22, 0.1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), SMALL).count() == 0
        assert out.where("doc_id = 1 and lang_pred <> 'mine'").count() == 0
    left = corpus_pipeline.STAGES[1][1](spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "None"]  # 4 is like 1, which is there twice
    assert corpus_pipeline.STAGES[0][1](spark, docs, SMALL).where("text is null").count() == 0
    assert docs.select(F.count("*")).first()[0] == 5

"""Scoring, WARC, URL rules, main text and media against brute force and round trips."""

import base64
import gzip
import hashlib
import html
import io
import math
import re
import time
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowloom.llm import main_text as main_text_module, media, url_rules, warc
from flowloom.llm.batches import BATCH_BYTES
from flowloom.llm.main_text import extract_main_text, main_text
from flowloom.llm import suffix_tree_lm as lm
from flowloom.llm.suffix_tree_lm import END, score_texts
from flowloom.session import shared_folder, table

SMALL = "/root/testdata/sf0.001"


# --- scoring ---


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def check_scores(rows):
    training = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10]
    counts = Counter(t for r in training for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_scores_of_documents(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    rows = score_texts(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    check_scores(rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (2, None), (3, ""), (10, "new words é É"), (None, "a b"), (7, "a b " * 20_000), (11, "A\x0bB\x1cC")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_texts(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    texts = dict(rows)
    check_scores([type(r)(**r.asDict(), text=texts[r.doc_id]) for r in got])
    assert score_texts(docs.where("false")).count() == 0


class PlainTree:
    """The suffix tree of a few texts, by dictionaries of word tuples."""

    def __init__(self, texts, depth=3):
        self.depth, rows = depth, [[END, *tokens(t)] for t in texts]
        counts = [Counter(tuple(r[i : i + k]) for r in rows for i in range(len(r) - k + 1)) for k in range(1, depth + 2)]
        counts[0][(END,)] -= len(rows)
        self.words, self.n = counts[0], sum(counts[0].values())
        self.floor = self.n + 0.1 * (len(self.words) + 1)
        self.states = {}  # context: (what it leaves, its steps)
        level = {g: (c, self.root(g[0])) for g, c in self.words.items()}
        for size in range(2, depth + 2):
            steps = {}
            for g, c in counts[size - 1].items():
                if c >= 2 and level.get(g[:-1], (0,))[0] >= 8 and level.get(g[1:], (0,))[0] >= 2:
                    steps.setdefault(g[:-1], {})[g[-1]] = (c, level[g[1:]][1])
            nexts = {}
            for context, some in steps.items():
                total = level[context][0]
                kept = sum(c for c, _ in some.values())
                gain = sum(c * math.log(c / total / below) for c, below in some.values())
                if kept < total:
                    gain += (total - kept) * math.log((1 - kept / total) / max(1 - sum(b for _, b in some.values()), 1e-12))
                rest = None
                if gain > 0.5 * (len(some) + 1) * math.log(total):
                    rest = 1 - sum(c - 0.6 for c, _ in some.values()) / total
                    self.states[context] = (rest, {w: (c - 0.6) / total for w, (c, _) in some.items()})
                for w, (c, below) in some.items():
                    nexts[(*context, w)] = (c, below if rest is None else (c - 0.6) / total + rest * below)
            level = nexts

    def root(self, word):
        return (self.words[(word,)] + 0.1) / self.floor

    def probability(self, context, word):
        p = self.root(word)
        for k in range(1, min(self.depth, len(context)) + 1):
            rest, steps = self.states.get(tuple(context[len(context) - k :]), (1.0, {}))
            p = steps.get(word, 0.0) + rest * p
        return p

    def score(self, text):
        row = [END, *tokens(text)]
        return sum(math.log10(self.probability(row[max(0, i - self.depth) : i], row[i])) for i in range(1, len(row)))


def training(rows):
    return [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 10]


def test_scores_equal_a_plain_tree(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    rows = docs.collect()
    tree = PlainTree(training(rows))
    assert {len(c) for c in tree.states} == {1, 2, 3}
    want = {r.doc_id: tree.score(r.text) for r in rows}
    for hot in (lm.HOT, 50):
        monkeypatch.setattr(lm, "HOT", hot)
        got = {r.doc_id: r.score for r in score_texts(docs).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_ranges_dealt_twice_and_long_rows_of_one_text(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in score_texts(docs).collect()}
    for name, value in {"COARSE": 1, "RANGE_BYTES": 1 << 14, "WEIGH_BYTES": 1 << 15, "HOT": 10}.items():
        monkeypatch.setattr(lm, name, value)
    got = {r.doc_id: (r.n_known, r.base_score, r.score) for r in score_texts(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1:] for k, v in got.items()} == {k: pytest.approx(v[1:], rel=1e-9) for k, v in want.items()}


def test_passes_over_the_ranges_add_up(spark, monkeypatch, tmp_path):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    docs = docs.unionAll(docs.limit(5))
    monkeypatch.setattr(lm, "WEIGH_BYTES", 1 << 16)
    monkeypatch.setattr(lm, "HOT", 100)
    plain, tables, got = lm.keep, [], {}
    monkeypatch.setattr(lm, "keep", lambda df, name: tables.append(name) or plain(df, name))
    for passes in (0, 1, 2):
        monkeypatch.setattr(lm, "PASSES", passes)
        tables.clear()
        rows = sorted(map(tuple, score_texts(docs).collect()))
        assert tables.count("sums") == 2**passes - 1
        got[passes] = [r[:5] for r in rows], [x for r in rows for x in r[5:]]
    for passes in (1, 2):
        assert got[passes][0] == got[0][0] and got[passes][1] == pytest.approx(got[0][1], rel=1e-9)


def test_a_worker_gives_its_memory_back():
    def work(batches):
        held = [np.ones(2048, np.int64) for _ in range(12000)]  # about 200 MB in small pieces
        yield from batches
        last.append(held[-1])  # keeps the heap from shrinking by itself

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    last, sizes = [], []
    for x in lm.giving_back(work)(iter([1])):
        sizes.append((x, resident()))
    assert sizes[0][0] == 1 and resident() < sizes[0][1] - 100


@pytest.mark.parametrize("part", [slice(None), slice(1, None), slice(3, 6), slice(1, 2)])
def test_symbols_are_told_apart_by_their_bytes(part):
    rows = ["a  b\tA\u00e9", None, "", " x ", "\x0b\x0c\r\n\x1c y" + "z" * 100, " ".join("w" * n for n in (1, 7, 8, 9, 16, 63, 64, 65, 66)), "\u00e9" * 40, "w\x00 w\x00\x00 w"][part]
    for kind in (pa.string(), pa.large_string()):
        some, codes, place = lm.symbols(pa.array(["", *rows], kind)[1:]), {}, 0
        for i, row in enumerate(rows):
            assert some.starts[i] == place
            for word in [END, *re.findall(rb"[^\x20\x09-\x0D]+", (row or "").encode().lower()), END]:
                code = int(some.low[place]), int(some.high[place])
                assert codes.setdefault(word, code) == code and some.owner[place] == i and code[1] & 1
                place += 1
        assert place == len(some.low) and len({c[0] for c in codes.values()}) == len(codes)
        assert (lm.symbols(pa.array(rows, kind), kinds=1).low == some.low).all()


def test_pairs_of_rare_words_are_not_sent(spark, monkeypatch):
    """Only a pair of a word of LEAST_STATE occurrences and one of LEAST_STEP can be a step."""
    sent = []
    plain = lm.counted
    monkeypatch.setattr(lm, "counted", lambda *a: sent.append(plain(*a)) or sent[-1])
    rows = [(i, f"often{i % 2} twice{i // 2} rare{i}") for i in range(1, 40)]
    score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert len(sent) == 4 and sent[0].where("size != 1").count() == 0
    assert 0 < sum(r.n for r in sent[0].collect()) == 4 * (len(rows) - held)


def test_weights_reach_tasks_by_ranges_not_by_rows(spark, monkeypatch):
    """A weight crosses to Python once, where its range is packed; from then on a range is a row of each kind."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    plain, packed, bounds = lm.keep, [], []
    monkeypatch.setattr(lm, "WEIGH_BYTES", 1 << 16)
    monkeypatch.setattr(lm, "HOT", 64)

    def keep(df, name):
        if name == "weights":
            bounds.append(spark.conf.get(BATCH_BYTES))
            kept = plain(df, name)
            packed.extend(kept.collect())
            return kept
        return plain(df, name)

    monkeypatch.setattr(lm, "keep", keep)
    before = spark.conf.get(BATCH_BYTES)
    score_texts(docs)
    ranges = [(r.at, bool(r.words)) for r in packed]
    assert len(ranges) == len(set(ranges)) and 2 < len({at for at, _ in ranges}) <= 1 << 10
    assert int(bounds[0]) == (1 << 31) - 1 and spark.conf.get(BATCH_BYTES) == before
    for r in packed:
        g = np.frombuffer(r.grams, np.uint64)
        assert (np.diff(g.astype(object)) > 0).all() and len(g) == r.held == len(r.adds) // 8 and bool(r.words) != bool(len(g))
    assert sum(len(r.top) // 32 for r in packed) < sum(r.held for r in packed)


@pytest.mark.parametrize("stretch", [5, 8, 20])
def test_bitmap_has_the_bits_of_its_hashes(spark, monkeypatch, stretch):
    monkeypatch.setattr(lm, "STRETCH", stretch)
    g = np.random.default_rng(3).integers(0, 2**64, 700, dtype=np.uint64)
    words = lm.bitmap(spark.createDataFrame([(x,) for x in g[:600].view(np.int64).tolist()], "g long").repartition(3), 600)
    want = np.zeros(len(words), np.uint64)
    for x in g[:600]:
        for k in lm.MARKS:
            want[int(x) % len(words)] |= np.uint64(1 << (int(x) >> k & 63))
    assert len(words) == 256 and (words == want).all()
    assert lm._may(words, g[:600]).all() and lm._may(words, g[600:]).sum() < 20
    assert not lm.bitmap(spark.createDataFrame([], "g long"), 0).any()


@pytest.mark.parametrize("bits", [0, 4])
def test_hashes_are_found_in_their_range(bits):
    rng = np.random.default_rng(4)
    codes = np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64) >> np.uint64(bits))
    codes[1:6] = codes[0]  # words of which one hash is equal
    high = np.arange(500, dtype=np.uint64)
    asked = np.r_[codes, codes + np.uint64(1), np.uint64(0)]
    second = np.r_[high, high, np.uint64(7)]
    got = lm.Index(codes, bits).places(asked, lambda i, at: high[at] == second[i])
    rows = {x: i for i, x in enumerate(zip(codes.tolist(), high.tolist(), strict=True))}
    assert got.tolist() == [rows.get(x, 500) for x in zip(asked.tolist(), second.tolist(), strict=True)]
    assert lm.Index(codes[:0], bits).places(asked).tolist() == [0] * len(asked)
    words, grams = lm._slots([asked[:500], np.r_[high[:250] * np.uint64(2) + np.uint64(1), np.zeros(250, np.uint64)], high.view(np.int64)[::-1] + 1, high / 7], 9.0)
    for hot, g, h in ((words, codes[:250], high[:250] * np.uint64(2) + np.uint64(1)), (grams, codes[250:], None)):
        place, here = hot.places(g, h)
        assert here.sum() > 150 and (hot.weight[place][here] == (high / 7)[(0 if h is not None else 250) :][:250][here]).all()
        assert not hot.places(g + np.uint64(1 << 40), h)[1].any()


def test_hashes_of_equal_first_bits_are_sorted():
    g = np.r_[np.random.default_rng(5).integers(0, 2**64, 2000, dtype=np.uint64), np.arange(50, 0, -1, dtype=np.uint64)]
    for some in (g, g[:2000], g[:1], g[:0]):
        order, rising = lm._sorted(some)
        assert (rising == np.sort(some)).all() and (some[order] == rising).all()


@pytest.mark.parametrize(("bits", "most"), [(0, 65535), (3, 65535), (3, 7)])
def test_blocks_of_a_range_tell_all_rows(monkeypatch, bits, most):
    monkeypatch.setattr(lm, "MOST", most)
    rng = np.random.default_rng(1)
    of, g, h = rng.integers(0, 50, 3000).astype(np.uint16), *rng.integers(0, 2**63, (2, 3000)).astype(np.uint64) * np.uint64(2)
    seen = []
    for at, block in lm._ranged(bits, of, g, h):
        some, owner, a, b = lm._unranged(block, 2)
        assert not bits or (a >> np.uint64(64 - bits) == at).all()
        seen += zip(some[owner].tolist(), a.tolist(), b.tolist(), strict=True)
    assert sorted(seen) == sorted(zip(of.tolist(), g.tolist(), h.tolist(), strict=True))
    assert list(lm._ranged(bits, of[:0], g[:0])) == [] and len(lm._unranged(b"", 1)[2]) == 0


def test_probabilities_sum_to_one(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    tree = PlainTree(training(rows))
    symbols = [w for (w,) in tree.words]
    never = 0.1 / tree.floor  # one word stands for all that was never met
    for context in [*[c for c in tree.states if len(c) == 3][:5], *list(tree.states)[:5], (b"never", b"met")]:
        left = never * math.prod(tree.states.get(context[-k:], (1.0,))[0] for k in range(1, len(context) + 1))
        assert sum(tree.probability(context, w) for w in symbols) + left == pytest.approx(1, abs=1e-9)


def test_a_text_that_occurs_twice_scores_above_others(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 60))) for i in range(1, 400)]
    rows += [(k, rows[10][1]) for k in (1001, 1002)]
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[rows[10][0]], got[1001], got[1002]) > max(v for k, v in got.items() if k not in (rows[10][0], 1001, 1002)) + 0.5


def test_scores_beside_columns_of_any_name(spark):
    rows = [(i, f"a b c {i % 3}") for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.selectExpr("doc_id as `the ``id`", "text as words", "1 as g", "2 as h", "3 as own", "map(1, 2) as k", "4 as score", "5 as id")
    want = {r.doc_id: r.score for r in score_texts(docs).collect()}
    got = score_texts(odd, "the `id", "words")
    assert {r[0]: r.score for r in got.collect()} == pytest.approx(want)


def test_runs_of_equal_content_are_each_scored(spark, monkeypatch):
    rows = [(1, "a b a b")] * 4 + [(2, "a b"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm, "SCORE_BYTES", 1)  # a run for each text
    got = score_texts(docs).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((k, len((t or "").split()) + 1) for k, t in rows)
    check_scores([type(r)(**r.asDict(), text=dict(rows)[r.doc_id]) for r in got])
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_contexts_of_three_words_are_learned(spark):
    rows = [(i, ("a x y p", "b x y q", "k n s", "l n t")[i % 4]) for i in range(1, 400)]
    asked = [(1004, "a x y p"), (1010, "a x y q"), (1018, "b x y q"), (1019, "b x y p")]  # held out
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows + asked, "doc_id long, text string")).where("doc_id > 1000 and held_out").collect()}
    assert got[1004] > got[1010] + 1 and got[1018] > got[1019] + 1  # y, and x y, are followed by either


def test_the_model_does_not_shrink_beside_more_text(spark):
    phrase = [(i, f"left{i % 3} right{i % 3}") for i in range(1, 40)]
    alone = score_texts(spark.createDataFrame(phrase, "doc_id long, text string")).where("doc_id = 1").first()
    docs = spark.createDataFrame([*phrase, (1001, "z " * 3_000_000), (1002, "z " * 3_000_000)], "doc_id long, text string")
    beside = score_texts(docs).where("doc_id = 1").first()
    assert alone.score - alone.base_score > 0.5
    assert beside.score - beside.base_score > alone.score - alone.base_score


# --- WARC ---


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [
    (1, "http://a/", "x\r\n\r\ny"),
    (2, "http://a/", "x\r\n\r\ny"),
    (9, "q", "x\r\n\r\ny"),
    (3, None, None),
    (4, "u v\nw", ""),
    (5, "http://b", "WARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (10, "http://é/", "é\x00" * 50_000),
    (11, "http://c", "own"),
    (11, "http://c", "own"),
]


def test_captures_are_read_as_written(spark):
    rows = {r.page_id: r for r in warc.capture_digests(pages_of(spark, PAGES)).collect()}
    for key, _, page in PAGES:
        payload = (page or "").encode()
        assert rows[key].payload_bytes == len(payload)
        assert rows[key].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items() if r.record_type == "revisit"} == {1: ("revisit", 9), 2: ("revisit", 9), 3: ("revisit", 4)}


def test_every_row_is_a_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", ((2, 2), (100, 1), (None, 1)))
    more = [*PAGES, (11, "http://d", "own"), (None, "http://c", "own"), (None, "http://c", "own"), (None, None, "no id"), (12, "http://c", "x" * 50)]
    pages = pages_of(spark, more).selectExpr("*", "map(1, 2) as digest", "3 as first", "4 as copies", "'a' as `o``dd`")
    got = warc.capture_digests(pages).toPandas()
    con = duckdb.connect()
    con.register("pages", pages_of(spark, more).toPandas().astype({"page_id": "Int64"}))
    want = con.sql(warc.ORACLE).df()
    rows = [sorted(map(repr, f[["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]].astype(object).where(lambda x: x.notna(), None).values.tolist())) for f in (got.astype({"page_id": "Int64", "refers_to": "Int64"}), want.astype({"page_id": "Int64", "refers_to": "Int64"}))]
    assert len(got) == len(more) and rows[0] == rows[1]


def test_least_size_of_a_revisit(spark):
    rows = {r.page_id: r.record_type for r in warc.capture_digests(pages_of(spark, PAGES), least=1).collect()}
    assert rows[3] == rows[4] == "response" and rows[1] == "revisit"


def test_assembled_captures(spark):
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(pages_of(spark, PAGES), folder)
    rows = warc.assemble(warc.read_records(spark, folder)).collect()
    by_page = {int(r.metadata.fields["page-id"]): r for r in rows}
    assert bytes(by_page[10].response.payload) == ("é\x00" * 50_000).encode()
    assert by_page[1].response.payload is None and by_page[1].response.refers_to == by_page[9].record_id
    assert by_page[11].request.fields["line"] == "GET http://c HTTP/1.1"


def test_no_pages(spark):
    assert warc.capture_digests(pages_of(spark, PAGES).where("false")).count() == 0


def test_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"abc", b"abc"]
    assert len(list(warc.parse(gzip.open(io.BytesIO(gzip.compress(good) * 3))))) == 3
    for bad in (good[:-8], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


# --- URL rules ---

URLS = [None, "", "x", "http://a.ORG/", "http://a.org", "https://u:p@b.Example.org/en/12?x", "x://example.org/es/#a", "http://Com/fr/a", "http://notcom/fr/", "http://a.com/de", "http://a.com/de/?q", "a://b://c.org/", "http://x.org\n/y", "http://x/" + "y/" * 20_000, "http://.org/", "HTTP://EXAMPLE.ORG/ES/", "http://a\nb.org/", "http://x.org\n", "http://org/x\ny", "http://a.b\\Ec.net/q"]


@pytest.mark.parametrize("more", [0, 40])
def test_verdicts(spark, more):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3])], "page_id long, url string").selectExpr("*", "'own' as rule", "1 as path")
    rules = [*url_rules.RULES, *[("block", f"h{i}.net", "/") for i in range(more)]]
    got = url_rules.judge_urls(pages, rules).drop("url").toPandas()
    assert len(got) == len(URLS) + 1
    con = duckdb.connect()
    con.register("pages", spark.createDataFrame([*enumerate(URLS)], "page_id long, url string").toPandas())
    want = con.sql(url_rules.ORACLE).df().sort_values("page_id")
    assert got.drop_duplicates().sort_values("page_id")[want.columns].fillna("").values.tolist() == want.fillna("").values.tolist()
    assert url_rules.judge_urls(pages.where("false")).count() == 0
    assert set(url_rules.judge_urls(pages, []).toPandas().verdict) == {"allow"}


def test_many_rules(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    hosts = [r.host for r in pages.select(url_rules.split_url()[0].alias("host")).distinct().collect()]
    rules = [*url_rules.RULES, *[("block", h, f"/{w}/{i}") for i, h in enumerate(hosts[:500]) for w in ("en", "de", "es", "fr")], *[("block", f"sub{i}.nowhere{i % 97}.net", f"/a{i}/") for i in range(20_000)]]
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert "Python" not in got._jdf.queryExecution().toString() and "ArrowEval" not in got._jdf.queryExecution().toString()
    split = [(r.page_id, r.host, r.path) for r in pages.select("page_id", *[c.alias(n) for c, n in zip(url_rules.split_url(), ("host", "path"), strict=True)]).collect()]
    by_end = {}
    for verdict, host, path in rules:
        by_end.setdefault(host, []).append((len(host + path), host + path, verdict, path))
    want = {}
    for key, host, path in split:
        labels = host.split(".")
        found = [x for i in range(len(labels)) for x in by_end.get(".".join(labels[i:]), []) if path.startswith(x[3])]
        best = max(found, default=(0, None, "allow"))
        want[key] = (best[1], best[2])
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want


# --- main text ---


def test_articles_of_pages(spark):
    rows = extract_main_text(table(spark, "/root/testdata/sf0.01", "pages").selectExpr("*", "'own' as text")).collect()
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_an_archive_of_others_is_resolved_by_its_references(spark, tmp_path):
    """Without metadata records all is told by the archive itself, but for the page ids."""
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "other"), (4, "http://d", "same"), (5, "u", "twice"), (6, "v", "twice"), (6, "v", "twice"), (None, "w", "same")]
    pages = pages_of(spark, rows)
    want = warc.capture_digests(pages).collect()
    folder = f"file://{tmp_path}/archives"
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder)
    got = warc.captured(warc.assemble(records.where("kind <> 'metadata'"))).collect()
    strip = lambda some: sorted((r.payload_bytes, r.payload_digest, r.record_type, r.uri) for r in some)
    assert strip(got) == strip(want) and all(r.page_id is None for r in got)
    named = records.where("kind = 'revisit'").count()
    assert named == sum(r.record_type == "revisit" for r in want) == 4
    assert {r.page_id: r.refers_to for r in want if r.record_type == "revisit"} == {1: 4, 2: 4, None: 4, 5: 6}


LONG = "A sentence that is long enough to be taken for the text of an article by anyone."


@pytest.mark.parametrize("aside", ["<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", '<div class="sidebar">{}</div>', '<div id="cookie-notice">{}</div>', '<section class="comments"><article class="comment"><p>{}</p></article></section>', '<div class="adBanner">{}</div>', "<header>{}</header>", '<div role="navigation">{}</div>', "<script>{}</script>", "<!-- {} -->", "<div hidden>{}</div>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div class="content has-sidebar">{}</div>'])
def test_other_parts_go(aside, frame):
    page = f"<html><head><title>T</title></head><body>{aside.format(LONG + ' Other.')}{frame.format(f'<h1>Head &amp; line</h1><p>{LONG}<p>Short.<p>{LONG}')}{aside.format('Go')}</body></html>"
    assert main_text(page) == f"Head & line\n\n{LONG}\n\nShort.\n\n{LONG}"


PARTS = [["Short."], ["- Yes.", "- No.", "- Why?", "- So.", "- Then go.", "- I will."]]


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("tag", ["<p>{}</p>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>"])
def test_short_closed_paragraphs_stay(parts, tag):
    high = LONG * 4
    page = f"<body><nav>Go</nav><div class=content><h1>Head</h1><p>{high}</p>{''.join(map(tag.format, parts))}<p>{high}</p><p>The end.</p></div><div class=footer>Mine</div></body>"
    assert main_text(page) == "\n\n".join(["Head", high, *parts, high, "The end."])


@pytest.mark.parametrize("around", ["<div class='layout-with-sidebar'>{}</div>", "<div id='content-sidebar-wrap'>{}</div>", "<form id=aspnetForm>{}</form>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div class=content>{}</div>", "<main>{}</main>"])
def test_no_ancestor_silences_the_article(around, frame):
    page = f"<body><nav>Go</nav>{around.format(frame.format(f'<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>'))}<div class=footer>Mine</div></body>"
    assert main_text(page) == f"Head\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("part", ["<section id='discussion'>{}</section>", "<h2 id='related-work'>{}</h2>", "<div id='search-results'>{}</div>"])
def test_names_inside_an_article(part):
    assert main_text(f"<article><p>{LONG}</p>{part.format('Part')}<div class='comments'>Reply</div></article>") == f"{LONG}\n\nPart"


PROSE = "Some other text that readers wrote about this, and it is long enough to look like an article."
INSIDE = ['<div class="comments-section"><p>{}</p></div>', '<div id="comments"><p>{}</p></div>', '<div class="related-posts"><p>{}</p></div>', '<div class="newsletter-box"><p>{}</p></div>', '<div class="share-bar">{}</div>', '<div class="social-share-buttons">{}</div>', '<div style="display: none">{}</div>']


@pytest.mark.parametrize("part", INSIDE)
def test_other_prose_inside_an_article(part):
    page = f"<body><nav><a href=x>Home</a><a href=y>About</a></nav><article><h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 3}</p>{part.format(PROSE)}</article></body>"
    assert main_text(page) == f"Head\n\n{LONG * 3}\n\n{LONG * 3}"


@pytest.mark.parametrize("part", ["<ul>" + "".join(f'<li><a href="/{i}">Another story about number {i} and things</a></li>' for i in range(8)) + "</ul>", '<div class="more-stories"><p>It happened elsewhere. Many people were there.</p></div>'])
def test_teasers_beside_an_article(part):
    page = f"<body><div class=post><h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 3}</p></div>{part}</body>"
    assert main_text(page) == f"Head\n\n{LONG * 3}\n\n{LONG * 3}"


def test_elements_that_stay_open_take_no_longer():
    began = time.perf_counter()
    assert main_text("<b>" * 20_000 + f"<p>{LONG}</p>" * 2000).count(LONG) == 2000
    assert main_text("<b>" * 20_000 + "<i>x</i></em>" * 2000) == "x" * 2000
    assert time.perf_counter() - began < 4


def test_link_lists_are_told_by_their_ratio(monkeypatch):
    links = "".join(f"<li><a href=/{i}>Go to {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><ul>{links}</ul></div></body>"
    assert main_text(page) == f"Head\n\n{LONG}\n\nShort.\n\n{LONG}"
    monkeypatch.setattr(main_text_module, "ratios", lambda lines: np.ones(len(lines)))
    assert "Go to 3" in main_text(page)


def test_the_ratio_decides_on_pages(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    texts = [main_text(p) for p in pages]
    monkeypatch.setattr(main_text_module, "ratio", lambda text, linked, tags: 100.0)
    assert sum(main_text(p) != t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)


@pytest.mark.parametrize("name", ["post category-popular", "post hentry tag-search", "content-with-sidebar", "comment-closed post", "post-1 type-post status-publish format-standard hentry category-news"])
def test_classes_of_an_article(name):
    comments = f"<ol class='comment-list'><li class='comment'><div class='comment-body'><p>{LONG}</p></div><ol class=children><li class=comment><p>{LONG}</p></li></ol></li></ol>"
    page = f"<body><header class=site-header>{LONG}</header><article class='{name}'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article><section class='comments-area'>{comments}</section></body>"
    assert main_text(page) == f"Head\n\n{LONG}\n\n{LONG}"


def test_ratio_smoothing_and_two_means_by_hand():
    m = main_text_module
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        lines = [m.Line("x" * int(a), int(b), int(a * c), 0, False, int(f), 0) for a, b, c, f in zip(rng.integers(0, 900, n), rng.integers(0, 5, n), rng.random(n), rng.integers(0, 3, n), strict=True)]
        raw = [min(len(x.text) - x.linked, 400) / (max(x.tags, 1) + x.linked / 4) for x in lines]
        want = []
        for i in range(n):
            near = [(math.exp(-((j - i) ** 2) / 2), raw[j]) for j in range(max(0, i - 3), min(n, i + 4))]
            want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        assert m.ratios(lines) == pytest.approx(want)
        values = np.log1p(want)

        def within(t):
            parts = [values[values < t], values[values >= t]]
            return sum(((p - p.mean()) ** 2).sum() for p in parts if len(p))

        best = min(sorted(set(values))[1:], key=within, default=values[0])
        apart = n > 1 and values[values >= best].mean() - values[values < best].mean() >= math.log(3)
        assert m.two_means(values) == pytest.approx(best if apart else values.min())


def test_pages_with_columns_of_any_name(spark):
    df = pages_of(spark, [(1, "u", f"<p>{LONG}")]).selectExpr("page_id as `a``b`", "html as text", "map(1, 2) as N_CHARS", "url as `x.y`")
    assert [tuple(r) for r in extract_main_text(df, "text").collect()] == [(1, "u", LONG, len(LONG))]


def test_odd_pages(spark):
    assert [main_text(x) for x in ("", "just text", "<p>one", "<p>a&#x41;&nbsp;b", "<article><p>x</article>", "<", "<p", "&", "<![CDATA[x]]>")][:5] == ["", "just text", "one", "aA b", "x"]
    assert main_text("<div>" * 5000 + LONG) == LONG
    assert len(main_text(f"<p>{'w ' * 100_000}</p>")) == 199_999
    rows = extract_main_text(pages_of(spark, [(1, None, None), (2, "u", ""), (2, "u", "")])).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0)] * 3
    assert extract_main_text(pages_of(spark, PAGES).where("false")).count() == 0


# --- media ---


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é" * 32, "mixed text " * 9_000, "a"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", "'own' as feature", "3 as media")
    rows = media.media_features(media.to_media(docs)).orderBy("doc_id").collect()
    for r in rows:
        raw = (r.text or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload = raw + bytes(size - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        with wave.open(io.BytesIO(bytes(r.media))) as file:
            assert (file.getsampwidth(), file.getnchannels(), file.readframes(file.getnframes())) == (1, 1, payload)
    assert rows[2].feature == rows[8].feature and rows[0].feature == rows[1].feature
    assert len(rows[7].peak_pairs) > 100 and rows[7].peak_pairs == sorted(rows[7].peak_pairs)
    assert media.media_features(media.to_media(docs.where("false"))).count() == 0


def test_peaks_of_a_tone():
    t = np.arange(4096)
    tone = (127 + 60 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8)
    times, bins = media.peaks(tone)
    assert (np.bincount(bins).argmax(), len(set(times.tolist()))) == (20, len(range(0, 4096 - media.FRAME + 1, media.HOP)))
    pairs = media.fingerprint(tone.tobytes())
    assert ((pairs >> 10 & 255) == 20).any() and len(np.unique(pairs)) == len(pairs)


def test_peak_pairs_by_hand():
    payload = hashlib.sha256(b"noise").digest() * 40
    x = np.frombuffer(payload, np.uint8).astype(float)
    x = np.r_[x, np.zeros(-(len(x) - media.FRAME) % media.HOP)]
    found = []
    for t, begin in enumerate(range(0, len(x) - media.FRAME + 1, media.HOP)):
        part = x[begin : begin + media.FRAME]
        shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
        power = np.abs(np.fft.rfft((part - part.mean()) * shape))
        tops = [k for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        found += [(t, k) for k in sorted(sorted(tops, key=lambda k: -power[k])[: media.PEAKS])]
    want = {a << 18 | i << 10 | j << 2 | (b - a) for a, i in found for b, j in found if 1 <= b - a <= media.AHEAD}
    assert set(media.fingerprint(payload).tolist()) == want


@pytest.mark.parametrize("size", [320, 448])
def test_the_last_bytes_are_in_a_window(size):
    payload = bytes(range(65, 91)) * 20
    one, other = payload[:size], payload[: size - 64] + b"ab" * 32
    assert media.fingerprint(one).tolist() != media.fingerprint(other).tolist()
    assert set(media.peaks(np.frombuffer(one, np.uint8))[0].tolist()) == set(range((size - 128) // 128 + 1))

"""Token counts and BPE against the libraries, on ordinary and odd texts."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from flowloom.llm.chunks import cut
from flowloom.llm.token_counts import count_tokens
from flowloom.llm.tree_bpe import bpe_digests, decode_bpe, encode_bpe, round_trip
from flowloom.session import table

R = random.Random(3)
LETTERS = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xB2, 0xBD, 0xE9, 0x558, 0x2003, 0x3000, 0x4E00, 0x1F600, 0x10940)]
ODD = [
    None,
    "",
    " ",
    "  two  spaces   three ",
    "a \n b\n  c",
    "<|endoftext|>",
    "x<|endoftext|>y <|endoftext|>",
    "a" * 5000,
    "ab" * 3000,
    " " * 3000 + "x",
    "\n" * 500,
    "=-" * 2000,
    "é" * 999,
    "日本語のテキスト。" * 50,
    "".join(R.choice("abcdefghij") for _ in range(2000)),
    *["".join(R.choice(LETTERS) for _ in range(R.randrange(80))) for _ in range(400)],
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "kept", 7.5) for i, t in enumerate(ODD)] + [(0, None, "again", 1.0), (0, None, "again", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, note string, n_tokens double")


def expected_counts(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def multi():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(odd):
    rows = count_tokens(odd).collect()
    assert len(rows) == len(ODD) + 2
    assert [r.n_tokens for r in rows] == expected_counts([r.text for r in rows])
    assert [r.n_bytes for r in rows] == [len((r.text or "").encode()) for r in rows]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert {r.note for r in rows} == {"kept", "again"}  # other columns stay, a clashing one is replaced


def test_counts_of_documents(spark):
    rows = count_tokens(table(spark, "/root/testdata/sf0.001", "documents")).collect()
    assert [r.n_tokens for r in rows] == expected_counts([r.text for r in rows])


def test_ids_are_the_librarys_and_decode_again(odd):
    library = multi()
    rows = decode_bpe(encode_bpe(odd)).collect()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert round_trip(odd).count() == 0


def test_digests(odd):
    library = multi()
    for r in bpe_digests(odd).collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_empty_table(odd):
    none = odd.where("false")
    assert count_tokens(none).count() == bpe_digests(none).count() == decode_bpe(encode_bpe(none)).count() == 0


def test_pieces_join_to_the_text():
    for text in ODD:
        assert " ".join(cut(text or "")) == (text or "")

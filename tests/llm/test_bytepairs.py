import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.fixtures import corpus, frame
from twinsift.llm import bytepairs


@pytest.fixture(scope="module")
def known():
    lines = open(public_tokenizers.path(bytepairs.RANKS), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "  a", "a  b", "a \n b\n\n", "don't we'll 'tis", "x" * 3000, "ab" * 700, "1234567890 12 3", "naïve  ÀÉÎ ß", "日本語 テキスト", "😀😃 😀",
    "\x00\x01 \x00a", "  x y", "end ", "\t\tTab", "<|endoftext|>", "á é", "Привет мир", "__init__ == -1.5e-3;", "\x1c \x1cq \x85z",
]


def test_ids_are_those_of_the_library(known):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("theinabc  .,'\n\té7😀") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts += ["".join(rng.choice("etaoin") for _ in range(2500))]  # one piece over LONG
    code = bytepairs.codec()
    coded = code.encode(texts)
    for text, said in zip(texts, coded):
        assert said == " ".join(map(str, known.encode_ordinary(text))), text[:50]


def test_long_and_short_pieces_contract_alike(known, monkeypatch):
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"abthein ") for _ in range(rng.randint(2, 90))) for _ in range(150)] + [b"a" * n for n in range(1, 40)]
    code = bytepairs.codec()
    one = code.pieces(pieces)
    monkeypatch.setattr(bytepairs, "LONG", 1)
    some = random.Random(1).sample(range(len(pieces)), 60)
    assert code.pieces([pieces[i] for i in some]) == [one[i] for i in some]
    assert [known.decode_bytes(list(map(int, ids.split()))) for ids in one] == pieces
    monkeypatch.setattr(bytepairs, "LONG", 1000)
    monkeypatch.setattr(bytepairs, "ROWS", 500)
    assert code.pieces(pieces) == one


def test_decoding_in_parts(monkeypatch):
    monkeypatch.setattr(bytepairs, "TOKENS", 7)
    code = bytepairs.codec()
    texts = ["one two three four five six seven eight nine ten", "", "x y", "Ünïcode 😀"]
    back = [b""] * 4
    for row, b in code.decode([bytepairs._numbers(said) for said in code.encode(texts)]):
        back[row] += b
    assert back == [t.encode() for t in texts]


def test_a_worker_forgets_and_learns_again(known, monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBER", 3)
    code = bytepairs.Codec(public_tokenizers.path(bytepairs.RANKS), public_tokenizers.PATTERN)
    for text in ["aa bb cc dd", "ee ff gg aa", "aa bb zz", "hh ii jj kk"]:
        assert code.encode([text])[0] == " ".join(map(str, known.encode_ordinary(text)))


def test_round_trip_of_a_corpus(spark, known):
    rows = corpus() + [(400 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = sorted(map(tuple, bytepairs.round_trip(frame(spark, rows)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = known.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_are_inverse(spark):
    docs = frame(spark)
    coded = bytepairs.encode(docs)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    back = sorted(((r.doc_id, bytes(r.bytes).decode()) for r in bytepairs.decode(coded).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    odd = spark.createDataFrame([(1, [15496, None, 9999999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in bytepairs.decode(odd).collect()} == {1: b"Hello", 2: b"", 3: b""}


def test_empty_table(spark):
    assert bytepairs.round_trip(frame(spark, [])).count() == 0
    assert bytepairs.decode(bytepairs.encode(frame(spark, []))).count() == 0

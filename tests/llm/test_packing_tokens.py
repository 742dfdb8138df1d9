import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import corpus, frame
from twinsift.llm import packing, tokens
from twinsift.llm.bpe import encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def data(x):
    return b"".join(i.to_bytes(4, "little") for i in x)


def test_ids_equal_the_tokenizers(spark):
    odd = ["  a  b\n c", "", " ", "a", " a", "it's\t b  ", "x  y 　z", "<|endoftext|> hi", "a\n\n b  c", "don't 'll é́ 12 3²", "a \x1f b", "\r\n x", "a​ b", "\x85 a \x85", "a  b", "\x00 \x00"]
    texts = odd + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [r[1] for r in corpus()]
    other = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts:
        assert encoder().encode(t) == data(ids(t)) == other.encode(t), t


@pytest.mark.parametrize("capacity", [2048, 50])
def test_pieces_and_packing(spark, capacity):
    rows = corpus()
    got = packing.pack_documents(frame(spark), capacity, keep_ids=True).collect()
    want = []
    for r in rows:
        x = [*ids(r[1]), 0]
        first = len(x) % capacity or capacity
        cuts = [0, *range(first, len(x) + 1, capacity)]
        want += [(r[0], n, a, b - a, zlib.crc32(data(x[a:b]))) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == len(best_fit([r["length"] for r in got], capacity))
    whole = packing.sequences(packing.pack_documents(frame(spark), capacity, keep_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole) and len(whole) == len(by)
    assert packing.pack_documents(frame(spark, []), capacity).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if sum(b) + x <= capacity]
        if fits:
            bins[max(fits, key=lambda i: sum(bins[i]))].append(x)
        else:
            bins.append([x])
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    plan = packing.best_fit_plan(Counter(lengths), capacity)
    bins = {}
    for s, lo, hi, first, per, offset in plan:
        for r in range(hi - lo):
            bins.setdefault(first + r // per, []).append((offset + r % per * s, s))
    for parts in bins.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= capacity
    assert sorted(s for p in bins.values() for _, s in p) == sorted(lengths)
    # bins of equal room are alike to the rule, so fills are compared, not contents
    assert sorted(sum(s for _, s in p) for p in bins.values()) == sorted(map(sum, best_fit(lengths, capacity)))


def test_histogram(spark):
    rows = corpus()
    n = sorted(len(ids(r[1])) for r in rows)
    hist = tokens.token_histogram(frame(spark))
    got = {r["n_tokens"]: r for r in hist.collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == dict(Counter(n))
    for k, r in got.items():
        assert r["docs_longer"] == sum(x > k for x in n) and r["tokens_longer"] == sum(x for x in n if x > k)
        assert r["truncated_total"] == sum(min(x, k) for x in n) and r["tokens_total"] == sum(n)
    for limit in (0, 1, 30, 77, 10**6):
        r = tokens.truncated_total(hist, limit).first()
        assert (r["tokens"], r["docs_cut"]) == (sum(min(x, limit) for x in n), sum(x > limit for x in n))
    assert tokens.quantile(hist, 0.5).first()["n_tokens"] == n[-(-len(n) // 2) - 1]
    assert tokens.token_histogram(frame(spark, [])).count() == 0
    assert sum(r["n_tokens"] for r in tokens.token_lengths(frame(spark)).collect()) == sum(n)

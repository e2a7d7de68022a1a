"""Words and runs that a polynomial modulo a power of two takes for one another whatever its base."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from editforge.llm import bpe, packing
from editforge.llm.common import chunks, words
from editforge.llm.line_dedup import PRIME, Sums, powers, remove_repeats, times
from editforge.llm.ngram_join import similar_documents
import pyarrow as pa


def balanced(one, other, n=1024):
    """The sequence that takes ``one`` where the number of set bits of its place is even, and its opposite."""
    odd = [i.bit_count() % 2 for i in range(n)]
    return [other if o else one for o in odd], [one if o else other for o in odd]


A, B = map("".join, balanced("a", "b"))


def hashes(text, lower=True):
    return [h for _, _, data, offsets in chunks(pa.array([text], pa.large_string())) for h in words(data, offsets, lower)[0].tolist()]


def test_words_differ():
    assert len(set(hashes(f"{A} {B} {A[:512]} {B[:512]} {A + A} {A + B} {B + A}"))) == 7
    assert hashes(f"{A} {A.upper()}")[0] == hashes(f"{A} {A.upper()}")[1]
    rng = np.random.default_rng(0)
    some = {"".join(rng.choice(list("abé"), rng.integers(1, 40))) for _ in range(20_000)}
    assert len(set(hashes(" ".join(some)))) == len(some)
    # Equal wherever they stand, also in other chunks.
    assert hashes("x " * 999 + A)[-1] == hashes(A)[0]


def test_tokens(spark):
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    pieces, added = packing.fast_merges(bpe.tokenizer_bytes(bpe.default_tokenizer()))
    own = bpe.own_merges(bpe.tokenizer_bytes(bpe.default_tokenizer()))
    texts = [A, B, f"{A} {B} {A}"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for p in (pieces, own):
        assert [x.tolist() for x in bpe.encode_texts(texts, p, added)] == want


def test_sets_do_not_link(spark):
    rows = [(1, f"one {A} two three four"), (2, f"one {B} two three four"), (3, f"one {B} two three four")]
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_no_word_is_deleted_that_stands_nowhere_earlier(spark):
    left, right = [f"l{i}" for i in range(60)], [f"r{i}" for i in range(60)]
    rows = [(1, " ".join([*left, A, *right])), (2, " ".join(["z", *left, B, *right, "q"]))]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2].split() == ["z", B, "q"]


def test_runs_of_two_words_differ(spark):
    one, other = balanced("yes", "no", 2048)
    h = np.array(hashes(" ".join(one + other)), np.uint64)
    run = Sums(h).runs(np.array([0, 2048]), np.array([2048, 4096]))
    assert run[0] != run[1]


@pytest.mark.parametrize("n", [1, 2, 5000])
def test_products_modulo_the_prime(n):
    p = int(PRIME)
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, p, n, np.uint64), rng.integers(0, p, n, np.uint64)
    a[0], b[0] = p - 1, p - 1
    assert times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    assert powers(12345, n)[:n].tolist() == [pow(12345, i, p) for i in range(n)]
    h = rng.integers(0, 1 << 64, n, np.uint64)
    s = Sums(np.concatenate([h, h]))
    assert s.runs(np.array([0, n]), np.array([n, 2 * n])).tolist()[0] == s.runs(np.array([n]), np.array([2 * n]))[0]

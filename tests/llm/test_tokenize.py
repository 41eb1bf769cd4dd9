import base64
import random

import pytest
import tiktoken

from traceloom.llm import tokenize

ranks_file = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=ranks_file.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return tokenize.PairEncoder()


def test_random_texts(coder, reference):
    rng = random.Random(8)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "漢字", "0", "12", "…", "😀", "​", "　", "\x1c", "<|endoftext|>", "AAAA", "!!", "\xa0", "\r\n", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert list(coder.encode(text)) == reference.encode_ordinary(text), repr(text)


def test_long_and_odd_texts(coder, reference):
    for text in ("a" * 5000, "ab" * 3000, " " * 3000, "x" + " " * 50 + "y", "supercalifragilistic" * 200, ""):
        assert list(coder.encode(text)) == reference.encode_ordinary(text)


def test_compatible_pairs_are_those_that_encode_to_themselves(coder, reference):
    rng = random.Random(1)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        joined = reference.decode_bytes([a, b]).decode("latin-1")
        data = joined.encode("latin-1")
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(tokenize.PIECES.findall(text)) == 1:
            assert coder.compatible(a, b) == (reference.encode_ordinary(text) == [a, b])


def test_table(spark):
    rows = [(1, "Hello world", 0), (2, "", 0), (3, None, 0), (3, "Hello world", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in tokenize.token_ids(df).collect())
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, [15496, 995])]
    assert tokenize.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0

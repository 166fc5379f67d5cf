import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assertia.llm.token_counts import ByteBPE, token_counts

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = ByteBPE(PATH, P.PATTERN)


def expected(texts):
    return [len(x.ids) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aaa the'ls \n\t<|endoftext|>")), max_size=60), max_size=6))
def test_equals_library(texts):
    assert OWN.count(texts) == expected(texts)


def test_awkward_texts():
    texts = ["", " ", "a" * 5000, "<|endoftext|>a<|endoftext|> <|endoftext|>", "x́‍\U0001f469 don't WON'T  \n\n y", "Ññbo ciónraue", "ab" * 3000, "12345 67²Ⅷ", "　  z\x00\x1c\x85"]
    assert OWN.count(texts) == expected(texts)


def test_frame(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (1, "the cat"), (None, "<|endoftext|>"), (4, "word " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_tokens", "1 as t")
    out = sorted(map(tuple, token_counts(df, PATH, P.PATTERN).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, expected([t or "" for _, t in rows]), strict=True)), key=str)
    assert out == want
    assert token_counts(df.limit(0), PATH, P.PATTERN).count() == 0


def test_rejects_other_files():
    with pytest.raises((ValueError, KeyError, TypeError)):
        ByteBPE(P.path("word_bpe_49k.json"), P.PATTERN)

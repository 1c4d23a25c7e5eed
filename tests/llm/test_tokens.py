import os
import random

import pytest

from quillon.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary()), reason="no vocabulary files")

TEXTS = [None, "", " ", "Hello, world!", "  two  blanks\n\n\tand tabs ", "<|endoftext|> is text", "don't we'll I'VE", "naïve Ωµ α₂ ﬁ 中文字 か゛ 🧪🔬", "1234567890 3.14e-5", "  thin​space　", "a" * 5000, "x y " * 4000, "é \U0001d49c \r\n\r\n  end  "]


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("head", [0, 3, 50_000])
def test_as_the_tokenizer(spark, head):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é中\n '’.,1² 🙂") for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' as ids", "'c' as word", "1 as pos", "2 as _k")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, head=head).collect()}
    assert got == {i: reference(t) for i, t in enumerate(texts)}
    counted = {r.doc_id: r.tokens for r in tokens.count_tokens(df, head=head).collect()}
    assert counted == {i: len(v) for i, v in got.items()}


def test_decoding_gives_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()] == [(1, reference("a"))]
    assert tokens.encode_corpus(df.limit(0)).count() == 0

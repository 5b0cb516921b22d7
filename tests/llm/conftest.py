import random

import pytest

from sigspark.llm.tokenization import tokenizer_path

ODD = ["", "   \n\t ", "!!!", "!!!", None, None, "one", "one two three four", "Released under the MIT License.",
       "a" * 5000, "日本語の長い文章が続く" * 200, "x\x00y", "é ü 😀", "word " * 300, "Line one here\nLine one here\n" * 40]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts with null ids, repeated rows and extra columns whose names clash with the operators' own."""
    rnd = random.Random(5)
    rows = [(i if i % 7 else None, t, ["en", "fr", None][i % 3], "s", None, "x", i, "y", 1.5, "z") for i, t in enumerate(ODD)]
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and"]
    for i in range(100, 130):
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))), "en", "s", 3, "x", i, "y", 0.5, "z"))
    rows += rows[-3:]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string, "
                                       "node long, name string, score double, kept string").repartition(3)


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer_path("word_bpe_49k.json")

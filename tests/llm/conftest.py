import pytest

WORDS = "the of and that is in re st ouwhea thshar édition ñandú 123 it's don't <|endoftext|> 漢字 emoji🙂".split()


@pytest.fixture(scope="session")
def odd_texts():
    """Texts at the edges: null, empty, white space of all sorts, repeats, very long ones, markup, other scripts."""
    import random

    rnd = random.Random(5)
    long = " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", ",", "!"]) for _ in range(9000))
    return [None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a \n b", "\ta b c \x1cd", "it's  they'LL 'S don't", "x" * 3000, "  lead and trail  ", long, long, "line one.\nline two!\n\n line three?", "İstanbul ΣΑΣ ǅ ﬁ é ́x", "<|endoftext|> ordinary <|startoftext|>", "a\x00b", "1234567 8 9", "..." * 50, "\n".join(["word"] * 5000) + " end", "a\n\nb.\nC&&&\nÉ,\n d"]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    rows = [(i, t, "en", "s", "clash", 1) for i, t in enumerate(odd_texts)] + [(None, "null id", None, None, None, None), (3, odd_texts[3], "en", "s", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, bucket int").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

import pytest

WORDS = "the of and a to in is you that it he was for on are as with his they I at be this have from or one had by word but not what all were we when your can said there".split()
#: Names that operators use themselves, to see that they don't mind them in the input.
CLASHING = "n bigint, tokens string, score double, component string, rep bigint, hits string, s bigint, complete boolean, label string"


@pytest.fixture(scope="session")
def passage():
    return " ".join(WORDS[i % 40] + str(i % 7) for i in range(60))


@pytest.fixture(scope="session")
def texts(passage):
    """Nulls, empty texts, repeats, near copies, and one very long text."""
    base = [WORDS[(i * i + 3 * i) % 40] + str(i) for i in range(100)]
    near = base[:50] + ["changed"] + base[51:]
    long = " ".join(WORDS[(i * 7919) % 40] + str(i % 1013) for i in range(30000))
    return [
        None, "", " \n\t", "one", "One", "two words", "a b c d e", "a b c d e", " ".join(base), " ".join(near), " ".join(base).upper(), long, long,
        "Crème brûlée! 中文字符 🎉🎉  double  spaces\n\nnew\x0bline\x0c\x1c\x85\xa0end ", passage, "x" * 5000, "...", passage + " tail", "a " * 3000, "it's I'll we've 12345 67,890.12",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "src", 1, 1, "x", 0.5, "c", 7, "h", 2, True, "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)

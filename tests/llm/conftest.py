import random

import pytest

#: Names that operators use for columns of their own.
CLASHES = ("grp", "shard", "linked", "text_key", "_key", "_doc", "bucket", "block", "word", "bytes", "doc", "component", "n", "label", "kept")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
SYLLABLES = {"aa": ("ka", "to", "mi", "ra", "ne"), "bb": ("sch", "ung", "ver", "ich", "ten")}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def table(spark, texts, langs=None):
    """Documents 0, 1, ... with these texts and extra columns with clashing names."""
    rows = [(i, t, (langs or {}).get(i), "s", None if t is None else len(t)) + ("x",) * len(CLASHES) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, blanks, a very long word, a very long text, copies, near copies, odd characters."""
    rng = random.Random(3)
    base = prose(rng, "aa", 120)
    near = " ".join("zz" if i == 60 else w for i, w in enumerate(base.split(" ")))
    return [None, "", " \n\t ", "one", "one two", base, base, near, "x" * 3000, prose(rng, "bb", 20_000), "é▁ 😀  two  spaces\ttab\0nul", base, "1 2 3", None]


@pytest.fixture(scope="session")
def edge(spark, edge_texts):
    return table(spark, edge_texts)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")

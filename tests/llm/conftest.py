import random

import pytest


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Odd texts, copies, near copies, junk and plain prose, with ids."""
    r = random.Random(4)
    base = words(r, 120)
    near = base.split()
    near[60] = "changed"
    rows = [None, "", " \n\t ", "one", "one two three four", "One  TWO three\tfour", "a b é́ x", base, base, base.upper(), " ".join(near), base + " tail", "x " * 300, "!!! ### " * 30, "la la la la la la la la la la la", "l1 a\nl1 a\n\nl2"]
    rows += [words(r, r.randint(1, 200)) for _ in range(40)]
    rows += [words(r, 9000)]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names clash with those of results, a null id, and a repeated row."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0, i, "x", 1.5, True) for i, t in texts]
    rows += [(None, "no id here at all, just text", "en", "s1", 0, 1, "x", 1.0, None), rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")

import random

import pytest


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and"]) for _ in range(n))


def corpus(seed=3, families=6, size=12, singles=30):
    """(doc_id, text): exact and near copies, shared passages, repeats, odd and empty texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = words(rng, rng.randrange(60, 200)).split()
        texts.append(" ".join(base))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(t))
        texts.append(" ".join(base))
    passage = words(rng, 60)
    for i in range(singles):
        t = words(rng, rng.randrange(0, 120))
        texts.append(f"{t}\n{passage} {words(rng, 5)}" if i % 3 == 0 else t)
    texts += [None, "", " \n\t", "one", "one", "two words", "Two WORDS", "ha " * 120, "é" * 5, "a b c\x1fd", "no end " * 3 + passage, "\U0001f600 emoji <|endoftext|> x"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [(i, t, ["en", "de", None][i % 3], [None, "src0", "src0", "src1"][i % 4], 7) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, one id with two texts, clashing and extra columns."""
    t = " ".join(f"v{i}" for i in range(40))
    r = [(None, t), (None, "short"), (5, t), (5, t), (5, t + " more words here"), (6, None), (7, t)]
    return spark.createDataFrame([(i, x, None, None, 1, "mine", "mine", 2) for i, x in r], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, `k` string, `a.b` int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")

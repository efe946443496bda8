"""Fixtures of the operators' tests; ``spark`` comes from the tests above."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, size long, kept boolean"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); the further columns bear names the operators use inside."""
    def make(rows):
        data = []
        for r in rows:
            doc, text, lang, source = (tuple(r) + (None, None))[:4]
            data.append((doc, text, lang, source, len(text) if text else 0, 7, 8, 9, True))
        return spark.createDataFrame(data, SCHEMA)

    return make


@pytest.fixture()
def work(spark):
    from groundtrace.llm.tables import Work

    made = Work(spark, "test")
    yield made
    made.release()


@pytest.fixture(scope="session")
def corpus():
    """Random documents with exact and near copies, shared passages, changed lines and odd texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(vocabulary) + (rng.choice([".", ".\n", ","]) if rng.random() < 0.15 else "") for _ in range(n))

    passage = text(30)
    docs = [(i, text(rng.randint(1, 120))) for i in range(60)]
    for i in range(60, 100):
        base = docs[rng.randrange(60)][1]
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join(words)))
    docs += [(i, text(20) + "\n" + passage + "\n" + text(20)) for i in range(100, 112)]
    docs += [(112, docs[5][1]), (113, docs[5][1].upper()), (114, docs[5][1].replace(" ", "\t ")), (115, None), (116, ""),
             (117, " \n\t"), (118, "x" * 3000), (119, "word " * 5000), (120, "\x0b\x0c a\x85b c")]
    rng.shuffle(docs)
    return docs

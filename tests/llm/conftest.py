import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def corpus(seed=3, n=160):
    """Texts with copies, near copies, shared passages, junk, empty and null texts, a repeated row and long words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 260))]
        kind = i % 8
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            near = (rng.choice(texts) or "x").split(" ")
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        elif kind == 3:
            at = rng.randrange(len(w))
            texts.append(" ".join(w[:at] + [passage] + w[at:]))
        elif kind == 4:
            texts.append("".join(x + rng.choice(["### ", "&&&\n", "  ", "\t"]) for x in w))
        elif kind == 5:
            texts.append((" ".join(w[:12]) + "\n") * rng.randint(2, 9))
        else:
            texts.append(" ".join(w).capitalize())
    texts[0:4] = [None, "", "  \n\t ", "\x00\x1c  don't \U0001f600 Ünïcode<|endoftext|> end"]
    return [(i, t, ["en", "de", None][i % 3], "hot", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, rows that share an id, rows without one."""
    long = " ".join(f"w{i}" for i in range(120))
    return spark.createDataFrame([(5, long, "en", "s", 1), (5, long, "en", "s", 1), (5, "other " * 60, "en", "s", 1), (None, long, None, None, None), (None, None, None, None, None), (9, long + " tail", "en", "s", 2)], DOCS)


@pytest.fixture(scope="session")
def clash(docs):
    """A table whose other columns are named like the operators' own."""
    out = docs
    for name in ("n_words", "score", "component_id", "fp", "hit", "token_ids", "kept", "held_out", "anchor", "id", "row", "count", "n", "word", "probability", "rule"):
        out = out.selectExpr("*", f"'x' AS {name}")
    return out

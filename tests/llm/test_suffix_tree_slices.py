"""The suffix tree reads and cuts each text once, where it lies, and keeps its token numbers compressed."""
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.llm import suffix_tree as S


def test_tokens_are_those_of_bytes_split():
    rng = random.Random(1)
    letters = "ab A\t\n\x0b\x0c\r\x1c\x1f\x85\xa0É 　\x00"
    for _ in range(300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        ids, words, starts = S.tokens(pa.array(texts, pa.string()))
        listed, want, begins = words.to_pylist(), [], []
        for t in texts:
            begins.append(len(want))
            want += [S.END, *t.encode().lower().split(), S.END]
        assert [listed[i] for i in ids] == want and starts.tolist() == begins


def test_rows_of_wide_columns_are_told_apart():
    for top in (7, 1 << 20, (1 << 31) - 1):
        columns = [np.random.default_rng(k).integers(0, top, 4000) % (97 if k else top) for k in range(3)]
        first, code = S.different_rows(columns)
        assert all((c[first][code] == c).all() for c in columns)
        assert len(first) == np.unique(np.stack(columns), axis=1).shape[1]


def test_texts_are_cut_once_without_a_shuffle(docs):
    read = S.pieces(docs.coalesce(2).cache(), S.held_out("doc_id", 5, 1), "text", "doc_id", S.buckets_of(docs, "text"))
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    tokens, size = read.where("_bucket IS NULL").select(F.sum(F.aggregate("docs.n_tokens", F.lit(0).cast("long"), lambda a, b: a + b + 1)), F.sum(F.octet_length("packed"))).first()
    assert tokens > 10_000 and size < 2.5 * tokens

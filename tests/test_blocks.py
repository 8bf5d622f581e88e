"""Blocks of vectors against plain inner products."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import blocks
from quern.operators import neighbours, tfidf


@pytest.mark.parametrize("docs, meetings", [(1024, 1 << 21), (7, 50), (1, 1)])
def test_blocks_find_every_pair_that_reaches_its_floor(monkeypatch, docs, meetings):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", docs)
    monkeypatch.setattr(blocks, "MEETINGS", meetings)
    rng = random.Random(5)
    vectors = [{key: rng.random() for key in rng.sample(range(-30, 30), rng.randint(1, 9))} for _ in range(40)]
    vectors = [{key: w / sum(v * v for v in vector.values()) ** 0.5 for key, w in sorted(vector.items())} for vector in vectors]
    df = {key: sum(key in vector for vector in vectors) for key in range(-30, 30)}
    lows = [rng.choice([-1e-9, 0.2, 0.6, float("nan")]) for _ in vectors]
    table = pa.table({
        "rep": pa.array(range(40), pa.int64()), "keys": [list(v) for v in vectors], "dfs": [[df[key] for key in v] for v in vectors],
        "places": [[sorted(v, key=lambda key: (df[key], key)).index(key) for key in v] for v in vectors],
        "weights": [list(v.values()) for v in vectors], "low": lows,
    })
    packed = list(blocks.pack(iter(table.to_batches(max_chunksize=11))))
    assert sum(len(block.column("reps")[0]) for block in packed) == 40
    found = {}
    for left in packed:
        for right in packed:
            both = pa.record_batch({**{n: left.column(n) for n in left.schema.names}, **{f"other_{n}": right.column(n) for n in left.schema.names if n != "lows"}})
            for out in blocks.compare(iter([both]), 0.5):
                found.update({(r["rep"], r["other"]): r["score"] for r in out.to_pylist() if r["met"] is None})
    score = {(a, b): sum(w * vectors[b].get(key, 0.0) for key, w in vectors[a].items()) for a in range(40) for b in range(40) if a != b}
    assert found and all(abs(found[pair] - score[pair]) < 1e-12 and not np.isnan(lows[pair[0]]) for pair in found)
    assert {pair for pair in score if score[pair] > 0 and score[pair] >= lows[pair[0]]} <= found.keys()


def test_pairs_of_all_documents_write_only_what_reaches_a_floor(spark, monkeypatch):
    """All documents share frequent words. Their pairs were rows of a shuffle and of a table."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("aa bb cc dd"), F.concat(F.lit("own"), F.col("id")), F.concat(F.lit("g"), F.floor(F.col("id") / 6))).alias("text"))
    index = tfidf.build_index(docs, "doc_id", "text", tfidf.Analyzer(largest=1))
    real, written = neighbours.store, {}

    def store(df, name, *rest):
        done = real(df, name, *rest)
        written[name] = done.count()
        return done

    monkeypatch.setattr(neighbours, "store", store)
    assert neighbours.similar_all(index, 5).found.count() == 600 * 5
    assert written["met"] <= 10 * 600, written

"""The model of word triples against a plain version and its SQL, and the arrays that it is stored in."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from limnokit.llm import hash_arrays, kneser_ney
from limnokit.llm.hash_arrays import NarrowKeys, gather, read_classes, read_counts, spread, write_classes, write_counts
from limnokit.llm.kneser_ney import all_probabilities, held_out, score, score_documents, tokens, train

from . import brute_turns as brute
from .conftest import ordered


@pytest.mark.parametrize("shards", [{}, {"WORDS_A_SHARD": 1 << 12, "PAIRS_A_SHARD": 1 << 8, "SHARDS_A_TASK": 2, "READ_TRIPLES": 100}])
def test_triple_scores(spark, docs, rows, monkeypatch, shards):
    for name, value in shards.items():
        monkeypatch.setattr(kneser_ney, name, value)
    got = score_documents(docs).select("doc_id", "n_tokens", "triple_score").collect()
    want = brute.triple_scores(rows)
    assert ordered(r[:2] for r in got) == ordered(r[:2] for r in want)
    assert sorted(r[2] for r in got) == pytest.approx(sorted(r[2] for r in want), abs=1e-7)


def test_scores_of_little(spark, docs, no_docs):
    assert score_documents(no_docs).count() == 0
    assert {r[0] for r in score(docs.select("doc_id", "text"), train(no_docs)).select("triple_score").collect()} == {0.0}
    for rows in ([(1, "")], [(1, None), (None, "one")], [(1, "a"), (3, "a b"), (4, "a b c")], [(1, "x x x x"), (4, "x")]):
        got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_tokens", "triple_score").collect()
        assert ordered(tuple(r[:2]) + (round(r[2], 9),) for r in got) == ordered((*r[:2], round(r[2], 9)) for r in brute.triple_scores(rows))


def test_triple_probabilities_sum_to_one(spark):
    texts = ["a b a c a b d", "b a b", "c", "", "a a a a e f g a b", "a b a c a b d", "e b a c c"]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = sorted({w for t in texts for w in t.split()})
    for context in ([], ["a"], ["a", "b"], ["b", "a"], ["a", "a"], ["unheard", "a"], ["c", "unheard"], ["d", "g"]):
        follow = pa.array([" ".join([*context, w]) for w in (*words, "unheard")] + [" ".join(context)])
        hashes, starts = tokens(follow)
        _, _, p = all_probabilities(model, hashes, starts)
        assert p[starts[:-1] + len(context)].sum() == pytest.approx(1.0, abs=1e-12)


def test_triples_know_more_than_pairs(spark):
    """Held-out texts whose next word follows from the two before it, not from the last one alone."""
    r = random.Random(5)
    step = {(a, b): r.randrange(40) for a in range(40) for b in range(40)}

    def text() -> str:
        out = [r.randrange(40), r.randrange(40)]
        while len(out) < 60:
            out.append(step[out[-2], out[-1]] if r.random() < 0.9 else r.randrange(40))
        return " ".join(f"w{w}" for w in out)

    docs = spark.createDataFrame([(i, text()) for i in range(900)], "doc_id long, text string")
    triples, pairs = score_documents(docs).filter("held_out").agg(F.sum("triple_score") / F.sum("n_tokens"), F.sum("score") / F.sum("n_tokens")).first()
    assert triples > pairs + 0.5


def test_triples_query_matches_sql(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    name = "op13_kneser_ney_triples"
    df = queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(oracle_sql()[name])
    assert [d[0] for d in res.description] == df.columns
    got, want = ordered(map(tuple, df.collect())), ordered(res.fetchall())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for at in (5, 6):
        assert [r[at] for r in got] == pytest.approx([r[at] for r in want], abs=2e-6)


@pytest.mark.parametrize("width", [1, 2, 7, 13, 40, 41, 63, 64])
def test_integers_are_spread_one_to_one(width):
    r = np.random.default_rng(width)
    x = np.unique(r.integers(0, 1 << width, 3000, dtype=np.uint64, endpoint=False) if width < 64 else r.integers(0, 1 << 64, 3000, dtype=np.uint64))
    there = spread(x, width)
    assert len(np.unique(there)) == len(x) and int(there.max()) < 1 << width and (gather(there, width) == x).all()


@pytest.mark.parametrize(("width", "bits"), [(9, 0), (20, 3), (32, 0), (36, 2), (44, 4), (44, 8), (45, 2), (64, 20)])
def test_narrow_keys_find_their_places(spark, width, bits):
    r = np.random.default_rng(width)
    keys = np.unique(r.integers(0, 1 << min(width, 63), 4000, dtype=np.uint64))
    # A run of close keys, none in the shard before them
    keys = np.concatenate([keys[: len(keys) // 3], keys[len(keys) // 3] + np.arange(300, dtype=np.uint64), keys[-9:]]) if width > 12 else keys
    keys = np.unique(keys)
    folder = hash_arrays.new_folder(spark, "test")
    shards = hash_arrays.shard_of(keys, bits, width)
    for shard in np.unique(shards):
        NarrowKeys.write(folder, int(shard), bits, width, keys[shards == shard])
    stored = NarrowKeys(folder, bits, width, np.bincount(shards, minlength=1 << bits))
    assert len(stored) == len(keys) and (stored.at(np.arange(len(keys))) == keys).all()
    asked = np.unique(np.concatenate([keys, r.integers(0, 1 << min(width, 63), 2000, dtype=np.uint64)]))
    at = np.searchsorted(keys, asked)
    there = keys[np.minimum(at, len(keys) - 1)] == asked
    assert (stored.places(asked) == np.where(there, at, -1)).all()


def test_counts_and_classes_are_read_as_written(spark):
    folder, r = hash_arrays.new_folder(spark, "test"), np.random.default_rng(2)
    for n in (1, 2, 1001):
        counts = np.minimum(r.geometric(0.3, n) - 1, 12) + r.integers(0, 2, n) * r.integers(0, 9, n) ** 6
        write_counts(folder, f"{n}.count", counts)
        at = r.permutation(n)
        assert (read_counts(folder, f"{n}.count", at) == counts[at]).all()
        numbers = np.stack([np.roll(counts, k) for k in range(3)], axis=1)
        write_classes(folder, f"{n}.classes", numbers)
        assert (read_classes(folder, f"{n}.classes", at) == numbers[at]).all()


def test_held_out_texts_teach_nothing(spark):
    rows = [(i, f"a b c{i % 3} d e{i % 5}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = docs.withColumn("text", F.when(held_out(), "b a z").otherwise(F.col("text")))
    want, got = ({r["doc_id"]: r["triple_score"] for r in score_documents(d).filter("not held_out").collect()} for d in (docs, changed))
    assert want == got and len(want) < 60

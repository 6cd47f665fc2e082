"""The registered corpus queries and the pipeline, each stage against a plain version of itself."""

from pathlib import Path

import corpus_pipeline
import pytest

from __spark_entry__ import oracle_sql, queries
from limnokit.llm.pii import mask
from limnokit.llm.quality import measure_quality
from limnokit.session import settle

from . import brute
from .conftest import ITEMS, ordered

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_take_effect(spark, docs, rows, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, step in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        after = settle(step(spark, now, str(tmp_path)), name)
        got = [(r["doc_id"], r["text"]) for r in after.collect()] if name != "packing" else None
        if name == "quality_rules":
            kept = measure_quality(now).filter("kept").select("doc_id").collect()
            assert ordered([(i,) for i, _ in got]) == ordered(kept)
            assert not [r for r in brute.quality(got) if r[6]]
        elif name == "near_dedup":
            groups = brute.near_groups(before, 5, 80)
            assert len(got) == len(groups)
            assert ordered((min(before[i][0] for i in g if before[i][0] is not None),) for g in groups if any(before[i][0] is not None for i in g)) == ordered(
                (i,) for i, _ in got if i is not None
            )
        elif name == "decontamination":
            clean = {r[0] for r in brute.contamination(before, ITEMS) if not r[5]}
            assert ordered(got) == ordered(x for x in before if x[0] in clean) and len(got) < len(before)
        elif name == "personal_data":
            assert ordered(got) == ordered((i, mask(t)) for i, t in before)
            assert all(len(r["text"]) == r["n_chars"] for r in after.collect())
        else:
            assert {r["doc_id"] for r in after.collect()} == {i for i, _ in before}
        if name != "packing":
            assert after.columns == docs.columns
        now = after


def test_empty_table(spark, no_docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = no_docs
    for _, step in corpus_pipeline.STAGES:
        now = settle(step(spark, now, str(tmp_path)), "empty")
        assert now.count() == 0


def test_every_operator_has_a_query():
    names = {x.split("_")[0] for x in queries() if x.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 11)} and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def table(spark):
    if not Path(SF).is_dir():
        pytest.skip("test tables are absent")
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize(
    ("name", "plain", "columns"),
    [
        ("op1_personal_data", brute.personal_data, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
        ("op3_near_dedup", brute.near_duplicates, ["doc_id", "n_shingles", "component_id", "kept"]),
        ("op6_repeats", brute.repeats, ["doc_id", "n_words", "n_removed", "kept_sha256"]),
        ("op10_quality", brute.quality, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    ],
)
def test_queries_match_plain_versions(spark, table, name, plain, columns):
    got = queries()[name](spark, SF).select(*columns).collect()
    assert ordered(got) == ordered(plain(table))


@pytest.mark.parametrize("name", ["op4_token_counts", "op5_html_text", "op7_secrets", "op8_token_store", "op9_packing", "pipeline"])
def test_queries_give_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0

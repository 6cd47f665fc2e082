"""Operators that compare rows with each other."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnokit.llm import near_dedup
from limnokit.llm.components import components
from limnokit.llm.decontam import drop_contaminated, find_contamination
from limnokit.llm.near_dedup import keep_one_of_each, near_duplicates, super_minhash
from limnokit.llm.packing import best_fit, complete_bins, lower_bound, pack_documents
from limnokit.llm.repeats import COVERS, _Combiner, cover_for, gathered, keyed_by_text, remove_repeats
from limnokit.llm.subwords import CachedTokenizer, tokenizer_path
from limnokit.llm.token_counts import count_tokens
from limnokit.llm.token_store import PackedIds, pack_ids, read_token_files, store_tokens, write_token_files

from . import brute
from .conftest import ITEMS, ordered, prose


def test_contamination(docs, no_docs, benchmark, rows):
    got = [tuple(r) for r in find_contamination(docs, benchmark).collect()]
    assert ordered(got) == ordered(brute.contamination(rows, [x for x in ITEMS if x[0] is not None]))
    kept = drop_contaminated(docs, benchmark)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not r[5] for r in got)
    assert find_contamination(no_docs, benchmark).count() == 0
    assert find_contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_near_duplicates(docs, no_docs, rows):
    got = [tuple(r) for r in near_duplicates(docs, 3, 85).collect()]
    assert ordered(got) == ordered(brute.near_duplicates(rows))
    assert near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(docs, no_docs, rows):
    kept = keep_one_of_each(docs, 5, 80)
    assert kept.schema == docs.schema
    want = Counter()
    for group in brute.near_groups(rows, 5, 80):
        texts = [rows[i] for i in group]
        if brute.shingles(texts[0][1], 5):
            ids = [i for i, _ in texts if i is not None]
            want[min(ids) if ids else None] += 1
        else:
            want.update(i for i, _ in texts)
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == want
    assert keep_one_of_each(no_docs).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A chain of copies and a star whose members are far from each other, in blocks of eight."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r, rows = random.Random(4), []
    chain = prose(7, 120).split()
    for i in range(40):
        chain[(3 * i) % 120] = f"c{i}"
        rows.append((i, " ".join(chain)))
    star = prose(8, 150).split()
    for i in range(40, 90):
        words = list(star)
        for k in r.sample(range(150), r.choice([1, 2, 3, 5, 8])):
            words[k] = f"s{i}x{k}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert ordered(got) == ordered(brute.near_duplicates(rows))


def test_signatures_estimate_similarity_and_are_full():
    r = np.random.default_rng(2)
    shared = r.integers(0, 2**63, 300, dtype=np.uint64)
    for n in (1, 7, 60, 300):
        a = np.concatenate([shared[:n], r.integers(0, 2**63, n, dtype=np.uint64)])
        b = np.concatenate([shared[:n], r.integers(0, 2**63, n, dtype=np.uint64)])
        marks = super_minhash(np.repeat([0, 1], 2 * n), np.concatenate([a, b]), 3, 256)
        assert (marks[:2] != near_dedup._EMPTY).all() and (marks[2] == near_dedup._EMPTY).all()
        assert abs((marks[0] == marks[1]).mean() - 1 / 3) < 0.13
        one = super_minhash(np.zeros(len(a), int), np.random.default_rng(n).permutation(a), 1, 256)
        assert (one[0] == marks[0]).all()


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (5, 5), (102, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("window", [35, 3])
def test_repeats(docs, no_docs, rows, window):
    got = [tuple(r)[:4] for r in remove_repeats(docs, window).collect()]
    assert ordered(got) == ordered(brute.repeats(rows, window))
    if window == 35:
        assert remove_repeats(no_docs).count() == 0


def test_repeat_places_are_bounded_by_one_text(spark):
    texts = [prose(900 + i, 60) for i in range(30)]
    rows = [(7, t) for t in texts] + [(7, texts[0])] * 30 + [(None, texts[0])] * 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    keyed = keyed_by_text(docs)
    assert keyed.select("id").distinct().count() == 31
    places = gathered(keyed.select("id", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("place")))
    assert {len(r["places"]) for r in places.collect()} == {26}
    assert ordered(tuple(r)[:4] for r in remove_repeats(docs).collect()) == ordered(brute.repeats(rows, 35))


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(35) == (21, COVERS[21]) and cover_for(1)[0] == 1


def test_payloads_give_any_id():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 20_000):
        for top in (2, 256, 257, 70_000, 2**32):
            ids = r.integers(0, top, n).astype(np.uint32)
            packed = PackedIds(pack_ids(ids))
            assert len(packed) == n and (packed[:] == ids).all()
            for _ in range(20 if n else 0):
                a, b = sorted(r.integers(0, n + 1, 2).tolist())
                assert (packed[a:b] == ids[a:b]).all()
                at = r.integers(0, n, 5)
                assert (packed[at] == ids[at]).all() and packed[int(at[0])] == ids[at[0]]


def ids_of(texts, name, end):
    tokenizer = CachedTokenizer(tokenizer_path(name), name.startswith("byte"))
    return [np.append(np.frombuffer(x, "<u2").astype("<u4"), np.uint32(end)).astype("<u4") for x in tokenizer.encode_whole(texts)]


def test_token_files(spark, docs, no_docs, rows, tmp_path):
    want, start = [], 0
    tie = dict(docs.select("text", F.xxhash64("text")).collect())
    ordering = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    for (doc_id, _), ids in zip(ordering, ids_of([t or "" for _, t in ordering], "word_bpe_49k.json", 1), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert ordered(tuple(r) for r in store_tokens(docs).collect()) == ordered(want)
    write_token_files(docs, str(tmp_path / "small"), block_tokens=50)
    assert ordered(tuple(r) for r in read_token_files(spark, str(tmp_path / "small")).collect()) == ordered(want)
    assert store_tokens(no_docs).count() == 0


def test_token_counts(docs, no_docs, rows):
    want = []
    for (doc_id, text), ids in zip(rows, ids_of([t or "" for _, t in rows], "byte_bpe_50k.json", 0), strict=True):
        want.append((doc_id, len((text or "").encode()), len(ids) - 1, len(ids) - 1 > 512))
    for sample in (4000, 3):
        assert ordered(tuple(r) for r in count_tokens(docs, sample_rows=sample).collect()) == ordered(want)
    assert count_tokens(no_docs).count() == 0


def fewest(items, capacity):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        put(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    put(0, [])
    return best


def test_bin_completion_finds_the_fewest():
    # fewer repetitions of a filling than the counts allow, two fillings of one largest length
    for counts, capacity in (({12: 4, 22: 1, 10: 4, 27: 1, 29: 3}, 50), ({5: 4, 9: 4, 19: 3, 16: 2}, 30)):
        assert sum(n for _, n in complete_bins(counts, capacity)) == 5
    r = random.Random(3)
    for _ in range(1000):
        capacity = r.choice([10, 20, 50])
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        for search in (complete_bins, best_fit):
            found = search(Counter(items), capacity)
            assert Counter(k for lengths, n in found for k in lengths * n) == Counter(items)
            assert all(sum(lengths) <= capacity for lengths, _ in found)
        n = sum(n for _, n in complete_bins(Counter(items), capacity))
        assert lower_bound(Counter(items), capacity) <= n == (fewest(items, capacity) if items else 0)


def test_packing(docs, no_docs, rows):
    found = pack_documents(docs).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    want: Counter = Counter()
    for (doc_id, _), ids in zip(rows, ids_of([t or "" for _, t in rows], "byte_bpe_50k.json", 2), strict=True):
        first, at, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while at < len(ids):
            stop = first if at == 0 else at + 1024
            want[doc_id, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())] += 1
            at, piece = stop, piece + 1
    assert pieces == want
    sizes = Counter(r["length"] for r in found)
    assert len(sequences) == lower_bound(sizes, 1024)
    assert pack_documents(no_docs).count() == 0


def test_many_equal_rows(spark):
    text = prose(9, 60)
    equal = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    removed = remove_repeats(equal).select("doc_id", "n_words", "n_removed").distinct().collect()
    assert [tuple(r) for r in removed] == [(7, 60, 60)]
    (ids,) = ids_of([text], "word_bpe_49k.json", 1)
    starts = sorted(tuple(r) for r in store_tokens(equal).collect())
    assert starts == [(7, k * len(ids), len(ids), zlib.crc32(ids.tobytes())) for k in range(3000)]
    places = {(r["sequence_id"], r["offset"]) for r in pack_documents(equal).collect()}
    assert len(places) == 3000
    found = _Combiner()
    for _ in range(5000):  # one window, met in equal rows: its first place and one more leave the task
        found.add(np.array([5], np.uint64), np.array([7]), np.array([3]))
    out = list(found.flush())
    assert sum(b.num_rows for b in out) == 2 and all(b.column("known").to_pylist() == [True, True] for b in out)

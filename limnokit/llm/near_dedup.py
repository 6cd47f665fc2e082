"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A set of shingles is hashed as follows. Every element draws a random order of
the ``m`` places of the signature and gives the place it draws in round ``j``
the value ``j + u`` with ``u`` from [0, 1); a place keeps its least value. Ranks
of one element differ, which lowers the variance. A place filled by round ``j``
holds less than ``j + 1``, so a text is done as soon as all its places are
filled: one round for long texts.

Texts with equal sets are one class from there on. Classes that share a band
of ``rows`` places meet in a bucket. Each bucket names the member met in most
buckets as its pivot, and each class is verified against one pivot; that links
groups of copies in one pass. Only members of a bucket that are not in its
pivot's component by then are compared on with all its members, in blocks of
bounded size, each with a union-find of its own. All links are verified on the full
sets. A pair is compared in the first band it shares and, before the sets are
compared, must agree in enough places of the signature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.llm.batches import text_pieces
from limnokit.llm.bitmaps import bitmap_of, in_bitmap
from limnokit.llm.components import components
from limnokit.llm.filtering import one_of_each, row_key, without_rows
from limnokit.llm.words import WordTable, mix, word_table
from limnokit.session import settle

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_EMPTY = np.iinfo(_U).max
#: Members of a block of a large bucket.
BLOCK = 256


def _step(k: int) -> np.uint64:
    """The k-th of a series of well spread 64-bit constants."""
    return _U(k * _GOLD & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(table: WordTable, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles as ``(text, hash)`` by text and hash; a shorter text is one shingle."""
    hashes = table.hashes()
    at, keys = table.grams(n, hashes)
    docs = table.doc[at]
    n_words = np.diff(table.first)
    for size in range(1, n):
        if (n_words == size).any():
            at, short = table.grams(size, hashes)
            own = n_words[table.doc[at]] == size
            docs, keys = np.concatenate([docs, table.doc[at[own]]]), np.concatenate([keys, short[own]])
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[first], keys[first]


def super_minhash(docs: np.ndarray, keys: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, ``n_docs x m``; ``docs`` ascends. A value is ``round << 32 | u``; texts without shingles stay empty."""
    out = np.full(n_docs * m, _EMPTY, _U)
    live_doc, live_key = docs, keys
    order: np.ndarray | None = None
    for j in range(m):
        if not len(live_key):
            break
        drawn = mix(live_key + _step(j + 1))
        value = _U(j) << _U(32) | drawn >> _U(32)
        step = ((drawn & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32)).astype(np.int64) + j
        if j == 0:
            place = step
        else:
            if order is None:  # after the first round: the order with its first swap made
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(live_key), 1))
                rows = np.arange(len(live_key))
                drawn0 = mix(live_key + _step(1))
                step0 = ((drawn0 & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)
                order[rows, step0] = 0
                order[:, 0] = step0
            rows = np.arange(len(live_key))
            place = order[rows, step].astype(np.int64)
            order[rows, step] = order[:, j]
        np.minimum.at(out, live_doc * m + place, value)
        open_docs = (out.reshape(n_docs, m) == _EMPTY).any(axis=1)
        live = open_docs[live_doc]
        live_doc, live_key = live_doc[live], live_key[live]
        if order is not None:
            order = order[live]
    return out.reshape(n_docs, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band of ``rows`` places, mixed with the number of the band."""
    out = np.zeros((len(signatures), bands), _U)
    for r in range(rows):
        out = mix(out + signatures[:, r : bands * rows : rows] + _step(r + 1))
    return mix(out + np.arange(1, bands + 1, dtype=_U) * _step(1))


def _digest(docs: np.ndarray, keys: np.ndarray, n_docs: int) -> list[bytes]:
    """128 bits that do not depend on the order of a set's elements."""
    sums = [np.zeros(n_docs, _U), np.zeros(n_docs, _U)]
    for k, total in enumerate(sums):
        np.add.at(total, docs, mix(keys + _step(k + 7)))
    pairs = np.stack([mix(x) for x in sums], axis=1).astype("<u8")
    return [x.tobytes() for x in pairs]


def _heads(names: list[bytes]) -> np.ndarray:
    """The first 64 bits of each class name."""
    return np.frombuffer(b"".join(names), _U)[::2]


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_pieces(batches):
            docs, keys = shingle_sets(word_table(texts, lower=True), shingle)
            n = len(texts)
            marks = super_minhash(docs, keys, n, bands * rows)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(np.bincount(docs, minlength=n).astype(np.int64)),
                    pa.array(names := _digest(docs, keys, n), pa.binary()),
                    pa.array(_heads(names).view(np.int64)),
                    pa.array([x.tobytes() for x in band_keys(marks, bands, rows)], pa.binary()),
                    pa.array([(x & _U(0xFFFF)).astype("<u2").tobytes() for x in marks], pa.binary()),
                ],
                ["doc_id", "row_key", "n_shingles", "class", "head", "bands", "marks"],
            )

    return run


def _full_sets(shingle: int, wanted):
    """Full sets of the texts whose class may be wanted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_pieces(batches):
            docs, keys = shingle_sets(word_table(texts, lower=True), shingle)
            n = len(texts)
            names = _digest(docs, keys, n)
            bound = np.searchsorted(docs, np.arange(n + 1))
            rows = np.flatnonzero(in_bitmap(wanted.value, _heads(names)) & (np.diff(bound) > 0))
            seen: dict[bytes, bytes] = {}
            for i in rows:
                seen[names[i]] = keys[bound[i] : bound[i + 1]].astype("<u8").tobytes()
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["class", "items"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether ``100 * |a & b| >= percent * |a | b|``; both sorted, without repeats and not empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = batch.column("items"), batch.column("pivot_items")
            ok = [similar(*(np.frombuffer(x[i].as_buffer(), "<u8") for x in (ours, theirs)), percent) for i in range(batch.num_rows)]
            yield batch.select(["class", "pivot"]).filter(pa.array(ok, pa.bool_()))

    return run


def compare_block(names: list, left: np.ndarray, bucket: int, bands: np.ndarray, marks: np.ndarray, sets: list, label: np.ndarray, percent: int, agree: int) -> list[tuple]:
    """Links that join components within a block; pairs with one of ``left`` (a mask) only.

    ``label`` numbers the components known before. A pair is left out if it
    shares an earlier band than ``bucket`` (it is compared there), agrees in
    fewer than ``agree`` places or is in one component already.
    """
    label, links = label.copy(), []
    for i in np.flatnonzero(left):
        others = np.flatnonzero(label != label[i])
        others = others[~((left[others]) & (others < i))]
        if bucket:
            others = others[~(bands[others, :bucket] == bands[i, :bucket]).any(axis=1)]
        others = others[(marks[others] == marks[i]).sum(axis=1) >= agree]
        for k in others:
            if label[k] != label[i] and similar(sets[i], sets[k], percent):
                links.append((names[i], names[k]))
                label[label == label[k]] = label[i]
    return links


def _compare_blocks(percent: int, agree: int):
    def run(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        names = rows.column("class").to_pylist()
        parts = {c: [np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in (("bands", "<u8"), ("marks", "<u2"), ("items", "<u8"))}
        label = np.unique([x.hex() for x in rows.column("component").to_pylist()], return_inverse=True)[1]
        left = np.array(rows.column("left").to_pylist(), bool)
        links = compare_block(
            names, left, rows.column("band")[0].as_py(), np.array(parts["bands"]), np.array(parts["marks"]), parts["items"], label, percent, agree
        )
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _spread(bands: int):
    """Each class once a band: ``band, bucket, class``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.record_batch(
                [pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys), batch.column("class").take(pa.array(np.repeat(np.arange(n), bands)))],
                ["band", "bucket", "class"],
            )

    return run


def near_links(classes: DataFrame, docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Links ``a, b`` that join all classes of one near-duplicate group; ``classes`` is settled."""
    all_members = classes.select("class", "bands").mapInArrow(_spread(bands), "band int, bucket bigint, class binary")
    who = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"who{i}") for i in range(2)]
    full = all_members.groupBy("band", "bucket").agg(F.count("*").alias("size"), *who).filter("size > 1")
    # buckets of other bands with the same members say nothing new about whom to compare
    full = full.groupBy("size", "who0", "who1").agg(F.min(F.struct("band", "bucket")).alias("at")).select("at.*", "size")
    members = settle(all_members.join(full, ["band", "bucket"]), "members")
    weight = members.groupBy("class").agg(F.sum("size").alias("weight"))
    weighted = members.join(weight, "class")
    pivots = weighted.groupBy("band", "bucket").agg(F.max(F.struct("weight", "class")).alias("pivot"))
    pivots = settle(pivots.select("band", "bucket", F.col("pivot.class").alias("pivot"), F.col("pivot.weight").alias("weight")), "pivots")
    chosen = (
        members.join(pivots, ["band", "bucket"])
        .filter(F.col("class") != F.col("pivot"))
        .groupBy("class")
        .agg(F.max(F.struct("weight", "pivot")).alias("best"))
        .select("class", F.col("best.pivot").alias("pivot"))
    )
    needed = settle(weight.join(classes.select("class", "head"), "class").select("class", "head"), "needed")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed, "head"))
    sets = docs.select("text").mapInArrow(_full_sets(shingle, wanted), "class binary, items binary")
    sets = settle(sets.join(needed, "class", "left_semi").dropDuplicates(["class"]), "sets")
    pairs = chosen.join(sets, "class").join(sets.select(F.col("class").alias("pivot"), F.col("items").alias("pivot_items")), "pivot")
    first = settle(pairs.mapInArrow(_verify(percent), "class binary, pivot binary").select(F.col("class").alias("a"), F.col("pivot").alias("b")), "links")
    known = settle(components(first), "known")
    labelled = members.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    centre = pivots.join(known.withColumnRenamed("node", "pivot"), "pivot", "left").select(
        "band", "bucket", F.coalesce("component", "pivot").alias("centre")
    )
    apart = settle(labelled.join(centre, ["band", "bucket"]).withColumn("left", F.col("component") != F.col("centre")), "apart")
    rest = apart.filter("left").groupBy("band", "bucket").agg(F.count("*").alias("n_left"))
    # blocks: those apart in n blocks against all members in blocks of the same size
    n_left, n_all = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_left", "size"))
    open_ = apart.join(rest, ["band", "bucket"]).withColumn("slot", F.pmod(F.xxhash64("class"), F.lit(1 << 30)))
    left_at = F.when(F.col("left"), F.col("slot") % n_left)
    all_at = F.col("slot") % n_all
    as_left = open_.filter("left").select("*", left_at.alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("k"), F.lit(True).alias("first"))
    as_other = open_.select("*", F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"), all_at.alias("k"), F.lit(False).alias("first"))
    keep = ["band", "bucket", "i", "k", "class", "component"]
    tasks = as_left.select(*keep, "first").unionByName(as_other.select(*keep, "first"))
    tasks = tasks.groupBy(*keep).agg(F.max("first").alias("left"))
    tasks = tasks.join(sets, "class").join(classes.select("class", "bands", "marks"), "class")
    agree = int(percent / 100 * bands * rows - 6.5 * (percent / 100 * (1 - percent / 100) * bands * rows) ** 0.5)
    second = tasks.groupBy("band", "bucket", "i", "k").applyInArrow(_compare_blocks(percent, agree), "a binary, b binary")
    return first.unionByName(settle(second, "block-links"))


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """``doc_id, row_key, n_shingles, component, component_id`` of every row of ``docs``.

    ``component`` names the group of a row; it is null for rows without
    shingles, which are linked with nothing.
    """
    sketch = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(
            _sketch(shingle, bands, rows),
            "doc_id bigint, row_key bigint, n_shingles bigint, class binary, head bigint, bands binary, marks binary",
        ),
        "sketch",
    )
    some = sketch.filter("n_shingles > 0")
    classes = some.groupBy("class", "head").agg(F.min("doc_id").alias("least"), F.min(F.struct("bands", "marks")).alias("sketch"))
    classes = settle(classes.select("class", "head", "least", "sketch.*"), "classes")
    parts = settle(components(near_links(classes, docs, shingle, percent, bands, rows)), "parts")
    owned = classes.select("class", "least").join(parts.withColumnRenamed("node", "class"), "class", "left")
    owned = owned.withColumn("component", F.coalesce("component", "class"))
    lowest = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    named = owned.join(lowest, "component").select("class", "component", "component_id")
    columns = ["doc_id", "row_key", "n_shingles", "component", "component_id"]
    empty = sketch.filter("n_shingles = 0").withColumns({"component": F.lit(None).cast("binary"), "component_id": F.col("doc_id")})
    return some.join(named, "class").select(*columns).unionByName(empty.select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Two texts are linked if ``100 * shared >= percent * all`` of their distinct
    ``shingle``-word shingles (A-Z lower-cased, words parted by ASCII white
    space; a shorter text is one shingle). ``component_id`` is the smallest id
    that links lead to. With 25 bands of 5 rows a link at 85 % is missed with
    a chance below 1e-6, at 80 % below 1e-4. Texts without words, and null
    texts, have an empty set and are linked with nothing. Repeated rows belong
    to one component; of rows that share an id all are kept or none. A null id
    takes the least id of its component, and is kept only if that has none.
    An empty table gives an empty result; other columns are ignored.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return near_groups(docs, shingle, percent, bands, rows).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least id, and all rows without shingles."""
    groups = settle(near_groups(docs, shingle, percent, bands, rows).filter("component IS NOT NULL").select("doc_id", "row_key", "component"), "groups")
    # the row that stays: least id, then least row key; it may be there several times
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    copies = groups.groupBy("component", "doc_id", "row_key").agg(F.count("*").alias("n"))
    chosen = F.col("row_key").eqNullSafe(F.col("first.row_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = copies.join(first, "component").withColumn("chosen", chosen)
    dropped = settle(judged.filter("NOT chosen OR n > 1").select("doc_id", "row_key", "chosen"), "dropped")
    again = dropped.filter("chosen").select("doc_id", "row_key")
    return without_rows(docs, dropped.select("doc_id", "row_key")).unionByName(one_of_each(docs, again))

"""Repeated passages found by difference-cover anchors.

The places 0, 1, 4, 14 and 16 modulo 21 are a difference cover: every
difference of two places modulo 21 is one of two cover places. So for two
equal windows of 35 words, wherever they start, there is a shift below 21 at
which both have a cover place, and the 15 words from there lie inside both
windows. Only the 15-grams at cover places (5 of 21) are hashed and compared
across the corpus: the anchors. Windows around anchors met twice are then
extended to their full length and compared by all their words.

Both comparisons count rows of one key and return the places of those met
twice; no two places are ever paired. A task first combines its own rows, so a
passage met everywhere is one row a task; the places it already knows to be
repeated travel under keys of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnokit.llm.batches import text_pieces
from limnokit.llm.bitmaps import bitmap_of, in_bitmap
from limnokit.llm.words import WordTable, mix, word_table
from limnokit.session import settle

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)
#: Period -> places, each a perfect difference set (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Anchors only nominate windows, so these many bits of their hashes do.
ANCHOR_BITS = 48
#: Rows a task combines at a time.
COMBINE_ROWS = 500_000
_PLACE = "key bigint, id bigint, pos int, known boolean"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least two fifths of the window."""
    period = max(p for p in COVERS if window - p + 1 >= max(1, 2 * window // 5))
    return period, COVERS[period]


class _Combiner:
    """Collects ``key, id, pos`` and marks the keys met twice within a task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> bool:
        self.parts.append((keys, ids, pos))
        self.rows += len(keys)
        return self.rows >= COMBINE_ROWS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        keys, ids, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.argsort(keys, kind="stable")
        keys, ids, pos = keys[order], ids[order], pos[order]
        same = keys[1:] == keys[:-1]
        later, known = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        later[1:] = same
        known[1:] |= same
        known[:-1] |= same
        # all but the first of equal keys are settled here and need not meet others; the high half stays as a check
        own = mix(ids[later].view(_U) ^ mix(pos[later].astype(_U)))
        keys[later] = (keys[later] & _HIGH) | (own & ~_HIGH)
        # equal rows of a table give equal places, of which one is enough
        at = np.flatnonzero(later)
        at = at[np.lexsort((pos[at], ids[at], keys[at]))]
        again = (keys[at[1:]] == keys[at[:-1]]) & (ids[at[1:]] == ids[at[:-1]]) & (pos[at[1:]] == pos[at[:-1]])
        keep = np.ones(len(keys), bool)
        keep[at[1:][again]] = False
        keys, ids, pos, known = keys[keep], ids[keep], pos[keep], known[keep]
        for a in range(0, len(keys), 100_000):
            cut = slice(a, a + 100_000)
            yield pa.record_batch(
                [keys[cut].view(np.int64), ids[cut], pos[cut].astype(np.int32), pa.array(known[cut])], ["key", "id", "pos", "known"]
            )


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def _places(table: WordTable, at: np.ndarray) -> np.ndarray:
    """Place of each word within its text."""
    return at - table.first[table.doc[at]]


def _anchors(window: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period, cover = cover_for(window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Combiner()
        for rows, texts in text_pieces(batches):
            table = word_table(texts)
            at, keys = table.grams(window - period + 1)
            pos = _places(table, at)
            use = np.isin(pos % period, cover) & (np.diff(table.first)[table.doc[at]] >= window)
            if found.add(keys[use] & _U((1 << ANCHOR_BITS) - 1), _ids(rows)[table.doc[at[use]]], pos[use]):
                yield from found.flush()
        yield from found.flush()

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each value of a list column, and the values."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), values


def _window_keys(table: WordTable, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each word, and which words start one."""
    keys, full = np.zeros(len(table.start), _U), np.zeros(len(table.start), bool)
    at, found = table.grams(window, table.hashes(1), 1)
    keys[at], full[at] = found, True
    return keys, full


def _candidates(window: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All windows that hold one of the anchors in ``places``."""
    period, _ = cover_for(window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Combiner()
        for rows, texts in text_pieces(batches):
            table = word_table(texts)
            keys, full = _window_keys(table, window)
            row, values = _flat(rows.column("places"))
            place = values.to_numpy(zero_copy_only=False).astype(np.int64)
            fits = place < np.diff(table.first)[row]  # those of another text with the same hash may lie beyond
            at = table.first[row[fits]] + place[fits]
            edge = np.zeros(len(table.start) + 1, np.int64)
            np.add.at(edge, np.maximum(at - period + 1, table.first[row[fits]]), 1)
            np.add.at(edge, at + 1, -1)
            use = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & full)
            if found.add(keys[use], _ids(rows)[table.doc[use]], _places(table, use)):
                yield from found.flush()
        yield from found.flush()

    return run


def met_twice(places: DataFrame) -> DataFrame:
    """Rows of ``places`` whose key another row has too, or that are known to be repeated."""
    n = F.count("*").over(Window.partitionBy("key"))
    return places.withColumn("n", n).filter((F.col("n") > 1) | F.col("known")).drop("n", "known")


def _digests(window: int, listed: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and kept words of texts; ``places`` has the repeated windows if ``listed``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_pieces(batches):
            table = word_table(texts)
            gone = np.zeros(len(table.start), bool)
            if listed:
                gone = repeated_words(table, rows.column("places"), window)
            kept = [kept_words(table, gone, i) for i in range(table.n_docs)]
            yield pa.record_batch(
                [
                    rows.column("doc_id"),
                    np.diff(table.first).astype(np.int64),
                    np.diff(np.concatenate([[0], np.cumsum(gone)])[table.first]).astype(np.int64),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.array([x.decode() for x in kept], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_words(table: WordTable, places: pa.Array, window: int) -> np.ndarray:
    """Mask of the words under the windows listed per text as high half of the hash | place, which is checked."""
    keys, full = _window_keys(table, window)
    row, values = _flat(places)
    packed = values.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
    place = (packed & ~_HIGH).astype(np.int64)
    fits = place < np.diff(table.first)[row]
    at = table.first[row[fits]] + place[fits]
    ours = full[at] & (((keys[at] ^ packed[fits]) & _HIGH) == 0)
    edge = np.zeros(len(table.start) + 1, np.int64)
    np.add.at(edge, at[ours], 1)
    np.add.at(edge, at[ours] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_words(table: WordTable, gone: np.ndarray, doc: int) -> bytes:
    """The words of a text that are not gone, joined by one space."""
    low, high = table.first[doc], table.first[doc + 1]
    left = np.flatnonzero(~gone[low:high]) + low
    data = table.seen
    return b" ".join([data[a:b].tobytes() for a, b in zip(table.start[left].tolist(), table.end[left].tolist(), strict=True)])


def _within(bitmap, inside: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(_ids(batch).view(_U))
            yield batch.filter(pa.array(in_bitmap(bitmap.value, keys) == inside))

    return run


def keyed_by_text(docs: DataFrame) -> DataFrame:
    """``doc_id, id, text``; only rows equal in both share an ``id``, a hash."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("id"), "text")


def gathered(places: DataFrame) -> DataFrame:
    """The distinct ``places`` of each ``id``."""
    return places.groupBy("id").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of every row of ``docs`` (``doc_id``, ``text``).

    A word (a run of anything but ASCII white space) is removed if a window of
    ``window`` words over it starts anywhere else too, in its own text or
    another row. ``kept_text`` joins the rest by one space. Null texts have no
    words. Repeated rows repeat each other. Places are gathered by a hash of id
    and text and each once, so an array is bounded by one text however many
    rows share an id. Texts shorter than a window lose nothing.
    """
    spark = docs.sparkSession
    work = keyed_by_text(docs)
    anchored = settle(
        gathered(met_twice(work.select("id", "text").mapInArrow(_anchors(window), _PLACE)).select("id", F.col("pos").alias("place"))),
        "anchored",
    )
    hashed = anchored.select("id").mapInArrow(_mixed_ids, "key bigint")
    bitmap = spark.sparkContext.broadcast(bitmap_of(settle(hashed, "anchored-ids"), "key"))
    shape = "doc_id bigint, id bigint, text string"
    likely, clean = (work.mapInArrow(_within(bitmap, x), shape) for x in (True, False))
    windows = likely.select("id", "text").join(anchored, "id").mapInArrow(_candidates(window), _PLACE)
    place = F.col("key").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.col("pos").cast("long"))
    repeated = gathered(met_twice(windows).select("id", place.alias("place")))
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    changed = likely.join(repeated, "id", "left").select("doc_id", "text", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))
    return changed.mapInArrow(_digests(window, True), out).unionByName(clean.select("doc_id", "text").mapInArrow(_digests(window, False), out))


def _mixed_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([mix(_ids(batch).view(_U)).view(np.int64)], ["key"])

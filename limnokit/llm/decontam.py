"""Benchmark decontamination by winnowed fingerprints.

Of every ``window - gram + 1`` consecutive k-grams of words the one with the
least hash is kept, the rightmost of equal ones. A run of ``window`` words
holds just that many k-grams, so equal runs keep the same k-gram, and every
shared run is found through a shared fingerprint. Fingerprints of documents
are kept if a bitmap of the benchmark's (bounded size) may hold them, joined
with those of the benchmark, and hits are extended word by word to both sides.
Items shorter than a window are one fingerprint of all their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnokit.llm.batches import text_pieces
from limnokit.llm.bitmaps import bitmap_of, in_bitmap
from limnokit.llm.filtering import row_key, without_rows
from limnokit.llm.words import WordTable, word_table
from limnokit.session import settle

_HIT = pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("lead", pa.int32()), ("words", pa.string())])
_HITS = "array<struct<key: bigint, pos: int, size: int, lead: int, words: string>>"


def winnow(table: WordTable, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the k-grams kept of texts of at least ``window`` words."""
    at, keys = table.grams(gram, hashes)
    span = window - gram + 1
    n = len(keys) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, least = np.arange(n), keys[:n].copy()
    for j in range(1, span):
        lower = keys[j : j + n] <= least
        best[lower] = np.flatnonzero(lower) + j
        least[lower] = keys[j : j + n][lower]
    whole = table.doc[at[:n]] == table.doc[at[span - 1 :]]
    kept = np.unique(best[whole])
    return at[kept], keys[kept]


def _hit_lists(table: WordTable, at: np.ndarray, keys: np.ndarray, size: np.ndarray, reach: np.ndarray) -> pa.ListArray:
    """One list of fingerprints a text, each with the words around it that a window through it can hold."""
    order = np.argsort(at, kind="stable")
    at, keys, size, reach = at[order], keys[order], size[order], reach[order]
    doc = table.doc[at]
    low = np.maximum(at - reach, table.first[doc])
    high = np.minimum(at + size + reach, table.first[doc + 1])
    words = [table.words(a, b).decode() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    rows = pa.StructArray.from_arrays(
        [
            pa.array(keys.view(np.int64)),
            pa.array((at - table.first[doc]).astype(np.int32)),
            pa.array(size.astype(np.int32)),
            pa.array((at - low).astype(np.int32)),
            pa.array(words, pa.string()),
        ],
        fields=list(_HIT),
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(table.n_docs + 1)), pa.int32()), rows)


def fingerprints(
    window: int, gram: int, short: list[int] | None, accept: Callable[[np.ndarray], np.ndarray] | None = None
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``id, row_key, text`` to ``id, row_key, n_words, hits``.

    ``short`` lists the sizes of short items to look for in every text; None
    takes each text shorter than a window as a short item itself. ``accept``
    tells which hashes are worth keeping.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_pieces(batches):
            table = word_table(texts, "alnum", lower=True)
            hashes = table.hashes()
            n_words = np.diff(table.first)
            found = [(*winnow(table, hashes, window, gram), gram, window - gram)]
            for size in range(1, window) if short is None else short:
                at, keys = table.grams(size, hashes)
                if short is None:
                    own = n_words[table.doc[at]] == size
                    at, keys = at[own], keys[own]
                found.append((at, keys, size, 0))
            if accept:
                found = [(at[ok], keys[ok], size, reach) for at, keys, size, reach in found for ok in [accept(keys)]]
            lengths = [len(x[0]) for x in found]
            at, keys = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            size, reach = (np.repeat([x[i] for x in found], lengths) for i in (2, 3))
            yield pa.record_batch(
                [rows.column("id"), rows.column("row_key"), pa.array(n_words, pa.int64()), _hit_lists(table, at, keys, size, reach)],
                ["id", "row_key", "n_words", "hits"],
            )

    return run


def _extend() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x in enumerate(batch.to_pylist()):
                ours, theirs = x["words"].split(" "), x["item_words"].split(" ")
                a, b, size = x["lead"], x["item_lead"], x["size"]
                if ours[a : a + size] != theirs[b : b + size]:
                    continue
                left = 0
                while left < min(a, b) and ours[a - left - 1] == theirs[b - left - 1]:
                    left += 1
                right = 0
                while right < min(len(ours) - a, len(theirs) - b) - size and ours[a + size + right] == theirs[b + size + right]:
                    right += 1
                if left + size + right >= x["needed"]:
                    out.append((i, x["pos"] - left, x["pos"] + size + right))
            rows, low, high = zip(*out, strict=True) if out else ((), (), ())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [kept.column("id"), kept.column("row_key"), kept.column("item_id"), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["id", "row_key", "item_id", "low", "high"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 6) -> DataFrame:
    """``doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and
    ``text``. Null or empty texts, and texts and items without words, match
    nothing. Repeated rows give a row each; rows of one id with other texts are
    judged apart. Repeated items count once. An item without an id marks words
    but is not listed. Other columns are ignored.
    """
    key = row_key().alias("row_key")
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.lit(0).cast("long").alias("row_key"), "text")
    shape = f"id {{}}, row_key bigint, n_words bigint, hits {_HITS}"
    prints = settle(
        items.mapInArrow(fingerprints(window, gram, None), shape.format("string"))
        .select(F.col("id").alias("item_id"), "n_words", F.explode("hits").alias("hit"))
        .select(
            "item_id",
            "hit.key",
            F.col("hit.size").alias("item_size"),
            F.col("hit.lead").alias("item_lead"),
            F.col("hit.words").alias("item_words"),
            F.least(F.col("n_words"), F.lit(window)).alias("needed"),
        )
        .distinct(),
        "item-prints",
    )
    short = [r["needed"] for r in prints.filter(F.col("needed") < window).select("needed").distinct().collect()]
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(prints, "key"))
    read = settle(
        docs.select(F.col("doc_id").cast("long").alias("id"), key, "text").mapInArrow(
            fingerprints(window, gram, short, lambda keys: in_bitmap(bitmap.value, keys)), shape.format("bigint")
        ),
        "doc-prints",
    )
    hits = (
        read.select("id", "row_key", F.explode("hits").alias("hit"))
        .select("id", "row_key", "hit.*")
        .join(prints, "key")
        .filter(F.col("size") == F.col("item_size"))
        .select("id", "row_key", "pos", "size", "lead", "words", "item_id", "item_lead", "item_words", "needed")
        .mapInArrow(_extend(), "id bigint, row_key bigint, item_id string, low bigint, high bigint")
    )
    hits = settle(hits.distinct(), "hits")
    who = ["id", "row_key"]
    so_far = Window.partitionBy(*who).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("high").over(so_far), F.lit(0))
    covered = (
        hits.select(*who, "low", "high")
        .distinct()
        .withColumn("fresh", F.greatest(F.lit(0), F.col("high") - F.greatest("low", seen)))
        .groupBy(*who)
        .agg(F.sum("fresh").alias("n_hit"))
    )
    listed = hits.groupBy(*who).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = covered.join(listed, covered["row_key"].eqNullSafe(listed["row_key"]) & covered["id"].eqNullSafe(listed["id"])).select(
        covered["id"], covered["row_key"], "n_hit", "items"
    )
    base = read.select("id", "row_key", "n_words")
    return base.join(both, base["row_key"].eqNullSafe(both["row_key"]) & base["id"].eqNullSafe(both["id"]), "left").select(
        base["id"].alias("doc_id"),
        base["row_key"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 6) -> DataFrame:
    """As :func:`contamination`, without ``row_key``."""
    return contamination(docs, benchmark, window, gram).drop("row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 6) -> DataFrame:
    """``docs`` without the rows that hold benchmark text; the others and all columns stay."""
    found = contamination(docs, benchmark, window, gram).filter("contaminated").select("doc_id", "row_key")
    return without_rows(docs, settle(found, "contaminated"))

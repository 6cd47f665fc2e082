"""Token counts of whole texts by a two-tier lookup on the map side.

The first tier is a compact table of the numbers of tokens of frequent units
(words with the blank before them): 9 bytes a unit, at most ``table_size``
units, broadcast. What it lacks is looked up in the units each worker keeps,
and only units new to a worker are encoded. No unit is ever shuffled, but those
of the bounded sample that fills the table. The table changes the speed only:
counts are those of the library whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.llm.batches import raw_text, text_pieces
from limnokit.llm.subwords import cached_tokenizer, tokenizer_path

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def frequent_units(docs: DataFrame, path: str, sample_rows: int = 4000, table_size: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and numbers of tokens of the units most often met in a sample of about ``sample_rows`` rows."""

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = cached_tokenizer(path, True)
        for _, texts in text_pieces(batches):
            keys, tokens, seen = tokenizer.unit_counts(texts)
            few = tokens < 256
            yield pa.record_batch([keys[few].view(np.int64), tokens[few], seen[few]], ["key", "tokens", "seen"])

    found = (
        docs.select("text")
        .sample(min(1.0, sample_rows / max(1, docs.count())), 7)
        .mapInArrow(units, "key bigint, tokens bigint, seen bigint")
        .groupBy("key", "tokens")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "key")
        .limit(table_size)
        .toArrow()
    )
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("tokens").to_numpy().astype(np.uint8)[order]


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None, sample_rows: int = 4000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and repeated
    or null ids give a row each; other columns are ignored. ``over_limit`` is
    ``n_tokens > limit``. An empty table gives an empty result.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    common = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, path, sample_rows))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = cached_tokenizer(path, True)
        for rows, texts in text_pieces(batches):
            n = tokenizer.counts(texts, common.value)
            yield pa.record_batch(
                [rows.column("doc_id"), np.diff(raw_text(texts)[1]), n, pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, COUNTS)

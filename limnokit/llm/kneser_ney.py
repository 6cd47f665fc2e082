"""Texts scored by interpolated modified Kneser-Ney models of word pairs and of word triples.

Tokens are the words of a text (runs of anything but ASCII white space, A-Z in
lower case) and then one end. Words are known by 64-bit hashes; a word's id is
its place in the sorted hash array, and a pair is the exact integer of its two
ids, so pairs have no collisions; a triple is that of the place of its first
pair and the id of its last word. All are counted in Spark: each task counts
what it meets and sends sorted blocks, one task a shard merges them into
sorted arrays in the shared folder. Scoring tasks map these files and look
their keys up in sorted order, so a task reads the pages its own keys lie in
and no text, pair or triple of it moves between machines.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(k(w) - E(k(w)), 0) / P + h / (V + 1)

is the model of pairs (``score``), and that of triples (``triple_score``) is

    p(w | u v) = max(c(uvw) - T(c(uvw)), 0) / c(uv) + t(uv) q(w | v)
    q(w | v)   = max(k(vw) - M(k(vw)), 0) / k(v.) + m(v) p(w)

``c`` counts in training texts, ``k(w)`` is the number of different words
before ``w``, ``P`` that of different pairs, ``V`` that of different tokens;
``k(vw)`` is the number of different words (or the start) before ``v w``, and
the count of the pair itself where ``v`` is the start, before which is nothing;
``k(v.)`` is its sum over all ``w``. ``D``, ``E``, ``T`` and ``M`` take one of
three discounts each by counts 1, 2 and more, and ``g``, ``h``, ``t`` and ``m``
are the mass they free, so the probabilities of the known tokens and of one
unknown token sum to 1. The start of a text is a context of its own, and all
there is before its first token: that one has ``q(w | v)``. After an unknown
pair the model of triples is ``q(w | v)``, after an unknown word both are
``p(w)``.

A null text is the empty text, whose one token is the end. A null ``doc_id``
counts as the empty text where texts are chosen for training. Without training
texts every probability is 1 (the unknown token is all there is). Rows that are
equal count as often as they come. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit.llm.batches import text_pieces
from limnokit.llm.hash_arrays import (
    NarrowKeys,
    SortedKeys,
    count_keys,
    gather,
    merged_shards,
    new_folder,
    read_array,
    read_classes,
    read_counts,
    spread,
    write_array,
    write_classes,
    write_counts,
)
from limnokit.llm.words import word_table
from limnokit.session import settle

_U = np.uint64
#: The end of a text among the hashes of words.
END = _U(0x5851F42D4C957F2D)
#: Text bytes a task scores at once.
SCORED_BYTES = 1 << 22
WORDS_A_SHARD, PAIRS_A_SHARD = 1 << 25, 1 << 19
#: Shards of triples that a task reads to count the words before their last pairs, and triples it works on at once.
SHARDS_A_TASK, READ_TRIPLES = 8, 1 << 20


def held_out() -> Column:
    """Texts that the model does not learn from, by a hash of their id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and where each text starts (one more at the end)."""
    table = word_table(texts, "space", lower=True)
    hashes = np.insert(table.hashes(), table.first[1:], END)
    return hashes, table.first + np.arange(len(table.first))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``x`` of."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> _U(27)) ^ (x >> _U(54))
    x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more, by the numbers of counts of 1 to 4; one half where they do not tell."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for k, (here, above) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        value = k - (k + 1) * y * above / here if here else 0.0
        out.append(value if 0 < value <= k else 0.5)
    return tuple(out)


def _less(counts: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    """Counts after the discount; nothing of nothing."""
    return counts - np.array([0.0, *cut])[np.minimum(counts, 3)]


@dataclass
class Words:
    """The sorted hash array of the words: a word's id is its place."""

    keys: SortedKeys

    def of(self, hashes: np.ndarray, columns: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ids (-1: unknown) of hashes in any order, and values of the columns (0: unknown)."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = np.full(len(distinct), -1, np.int64)
        values = {c: np.zeros(len(distinct), kind) for c, kind in columns.items()}
        for shard, part, at, there in self.keys.parts(distinct):
            ids[part] = np.where(there, at + self.keys.starts[shard], -1)
            for c, kind in columns.items():
                if there.any():
                    values[c][part] = np.where(there, read_array(self.keys.folder, f"{shard}.{c}", kind)[at], 0)
        return ids[back], {c: v[back] for c, v in values.items()}


def _width(n: int) -> int:
    """Bits that hold every integer below ``n``."""
    return max(1, (n - 1).bit_length())


def _pairs_of(before: np.ndarray, after: np.ndarray, n_words: int) -> np.ndarray:
    return spread(before.astype(_U) * _U(n_words) + after.astype(_U), _width(n_words * (n_words + 1)))


def pair_keys(ids: np.ndarray, starts: np.ndarray, n_words: int) -> np.ndarray:
    """One integer for each token and the one before it, spread over as many bits as it needs; id ``n_words`` is the start of a text."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[starts[:-1]] = n_words
    return _pairs_of(before, ids, n_words)


def _pair_ends(keys: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the two tokens of pairs."""
    before, after = np.divmod(gather(keys, _width(n_words * (n_words + 1))), _U(n_words))
    return before.astype(np.int64), after.astype(np.int64)


@dataclass
class Triples:
    """Sorted triples: the place of the pair they begin with, then the id of the last word in ``word_bits`` bits.

    Arrays by place of a pair are cut into blocks like the triples that begin
    with it: ``classes`` has the number of triples met once, twice and more
    that begin with it, ``before`` the number of tokens met before it (no
    entry where every such number of a block is 1).
    """

    keys: NarrowKeys
    word_bits: int
    counted: frozenset[int] = frozenset()
    cuts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    middle: tuple[float, float, float] = (0.5, 0.5, 0.5)
    start_gamma: float = 0.0

    @property
    def block_bits(self) -> int:
        """Places in a block, as a power of 2."""
        return self.keys.width - self.word_bits - self.keys.bits

    def key(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return places.astype(_U) << _U(self.word_bits) | ids.astype(_U)

    def blocks(self, places: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """For sorted places of pairs: block, the slice of the places in it, and the places there."""
        bounds = np.searchsorted(places, np.arange((1 << self.keys.bits) + 1, dtype=np.int64) << self.block_bits)
        for block in np.flatnonzero(np.diff(bounds)):
            part = slice(int(bounds[block]), int(bounds[block + 1]))
            yield int(block), part, places[part] - (int(block) << self.block_bits)

    def before(self, places: np.ndarray) -> np.ndarray:
        """The number of different tokens before pairs at sorted places (not those at the start of a text)."""
        out = np.ones(len(places), np.int64)
        for block, part, at in self.blocks(places):
            if block in self.counted:
                out[part] = read_counts(self.keys.folder, f"{block}.before", at)
        return out

    def classes(self, places: np.ndarray) -> np.ndarray:
        """The numbers of triples met once, twice and more that begin with pairs at sorted places (not those at the end of a text)."""
        out = np.zeros((len(places), 3), np.int64)
        for block, part, at in self.blocks(places):
            out[part] = read_classes(self.keys.folder, f"{block}.classes", at)
        return out


@dataclass
class Model:
    """Where the arrays of the model lie, and its few single numbers."""

    words: Words
    pairs: NarrowKeys
    triples: Triples
    n_tokens: int
    n_texts: int
    cuts: tuple[float, float, float]
    start_gamma: float
    unknown: float


def _bits(total: int, each: int) -> int:
    return max(0, math.ceil(math.log2(max(1, total / each))))


def _word_shards(folder: str, bits: int) -> Callable:
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in merged_shards(batches, bits):
            write_array(folder, f"{shard}.key", keys)
            write_array(folder, f"{shard}.count", counts)
            row = [shard, len(keys), int(counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _sizes(rows: list, bits: int) -> np.ndarray:
    sizes = np.zeros(1 << bits, np.int64)
    for row in rows:
        sizes[row["shard"]] = row["n"]
    return sizes


# Facts of words from the pairs of one shard, by the shard of the word; shard -1: of the pairs themselves, -2: of the start of a text
FACTS_DDL = "shard int, pair_shard int, n long, kind string, ids binary, numbers binary, total array<long>"
FACTS = pa.schema(
    [("shard", pa.int32()), ("pair_shard", pa.int32()), ("n", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("numbers", pa.binary()), ("total", pa.list_(pa.int64()))]
)


def _small(values: np.ndarray) -> bytes:
    """One byte for the size of an element, then the elements."""
    size = next(s for s in (1, 2, 4, 8) if not len(values) or values.max() < 1 << 8 * s)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _large(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _levels(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def _row(schema: pa.Schema, *values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _by_word_shard(words: SortedKeys, kind: str, ids: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
    """Sorted ids cut at the bounds of the word shards; ids as steps from one to the next."""
    bounds = np.searchsorted(ids, words.starts)
    for shard in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[shard], bounds[shard + 1])
        yield int(shard), -1, 0, kind, _small(np.diff(ids[part], prepend=words.starts[shard])), _small(numbers[part].ravel()), None


def _contexts(before: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different contexts of pairs, the number of pairs of counts 1, 2 and more, and the sum of the counts."""
    context, at = np.unique(before, return_inverse=True)
    numbers, total = np.zeros((len(context), 3), np.int64), np.zeros(len(context), np.int64)
    np.add.at(numbers, (at, np.minimum(counts, 3) - 1), 1)
    np.add.at(total, at, counts)
    return context, numbers, total


def _pair_shards(folder: str, bits: int, width: int, words: SortedKeys) -> Callable:
    n_words = len(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in merged_shards(batches, bits, width):
            NarrowKeys.write(folder, shard, bits, width, keys)
            write_counts(folder, f"{shard}.count", counts)
            before, after = _pair_ends(keys, n_words)
            rows = [(-1, shard, len(keys), "pairs", None, None, _levels(counts))]
            rows += _by_word_shard(words, "after", *np.unique(after, return_counts=True))
            context, numbers, _ = _contexts(before, counts)
            if len(context) and context[-1] == n_words:
                rows.append((-2, -1, 0, "start", None, None, numbers[-1].tolist()))
                context, numbers = context[:-1], numbers[:-1]
            rows += _by_word_shard(words, "before", context, numbers)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FACTS, strict=True)], schema=FACTS)

    return run


def _word_facts(words: SortedKeys, kinds: dict[str, int], summary: str) -> Callable:
    """Sums the facts of each word shard, so many numbers a kind, into one row; passes the other rows on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> tuple:
            first = sums[next(iter(kinds))]
            return now, -1, int(first[:, 0].sum()), summary, None, _small(np.concatenate([v.ravel() for v in sums.values()])), _levels(first[:, 0])

        now, sums = None, {}
        for batch in batches:
            rows = []
            for shard, pair_shard, n, kind, ids, numbers, total in zip(*[batch.column(c).to_pylist() for c in FACTS.names], strict=True):
                if shard < 0:
                    rows.append((shard, pair_shard, n, kind, None, None, total))
                    continue
                if shard != now:
                    if now is not None:
                        rows.append(whole())
                    now, sums = shard, {k: np.zeros((words.sizes[shard], size), np.int64) for k, size in kinds.items()}
                sums[kind][np.cumsum(_large(ids))] += _large(numbers).reshape(-1, kinds[kind])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FACTS, strict=True)], schema=FACTS)
        if now is not None:
            yield _row(FACTS, *whole())

    return run


def _finished(folder: str, words: SortedKeys, cuts: tuple, lower: tuple, n_pairs: int, free: float) -> Callable:
    """Probability of every word alone, and the mass it leaves as a context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                count, numbers = read_array(folder, f"{shard}.count", "<i8"), _large(packed)
                after, before = numbers[: words.sizes[shard]], numbers[words.sizes[shard] :].reshape(-1, 3)
                write_array(folder, f"{shard}.alone", _less(after, lower) / n_pairs + free / (len(words) + 1))
                write_array(folder, f"{shard}.gamma", before @ np.array(cuts) / count)
            yield pa.RecordBatch.from_arrays([batch.column("shard")], names=["shard"])

    return run


TRIPLES_DDL = "shard int, n long, total array<long>"
TRIPLES = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def _triple_shards(triples: Triples) -> Callable:
    """The arrays of each shard, and the numbers of triples that begin with each pair."""
    folder, bits, width = triples.keys.folder, triples.keys.bits, triples.keys.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in merged_shards(batches, bits, width):
            NarrowKeys.write(folder, shard, bits, width, keys)
            write_counts(folder, f"{shard}.count", counts)
            begin = (keys >> _U(triples.word_bits)).astype(np.int64) - (shard << triples.block_bits)
            classes = [np.bincount(begin[np.minimum(counts, 3) == k], minlength=begin[-1] + 1) for k in (1, 2, 3)]
            write_classes(folder, f"{shard}.classes", np.stack(classes, axis=1))
            yield _row(TRIPLES, shard, len(keys), _levels(counts))

    return run


def _last_pairs(pairs: NarrowKeys, triples: Triples, n_words: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """The places of the last pairs of all triples of a shard; of those pairs that occur more than once."""

    def places_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for shard in batch.column("shard").to_pylist():
            low, high = triples.keys.starts[shard], triples.keys.starts[shard + 1]
            for start in range(low, high, READ_TRIPLES):
                keys = triples.keys.at(np.arange(start, min(high, start + READ_TRIPLES)))
                begin, back = np.unique((keys >> _U(triples.word_bits)).astype(np.int64), return_inverse=True)
                middle = _pair_ends(pairs.at(begin), n_words)[1][back]
                last = np.sort(_pairs_of(middle, (keys & _U((1 << triples.word_bits) - 1)), n_words))
                places, counts = _found(pairs, last)
                yield places[counts > 1].astype(_U)

    return places_of


def _tokens_before(triples: Triples, n_pairs: int) -> Callable:
    """The number of different tokens before each pair of a block."""
    folder, bits, width = triples.keys.folder, triples.keys.bits, triples.keys.width - triples.word_bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, places, numbers in merged_shards(batches, bits, width):
            first = block << triples.block_bits
            before = np.ones(min(1 << triples.block_bits, n_pairs - first), np.int64)
            before[places.astype(np.int64) - first] = numbers
            write_counts(folder, f"{block}.before", before)
            yield _row(TRIPLES, block, len(places), None)

    return run


def _middle_facts(pairs: NarrowKeys, triples: Triples, words: SortedKeys) -> Callable:
    """Facts of words as contexts in the middle of triples, from the pairs of one shard."""
    n_words = len(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                places = np.arange(pairs.starts[shard], pairs.starts[shard + 1])
                if not len(places):
                    continue
                before, _ = _pair_ends(pairs.at(places), n_words)
                counts = np.where(before == n_words, read_counts(pairs.folder, f"{shard}.count", places - pairs.starts[shard]), triples.before(places))
                rows = [(-1, shard, len(places), "pairs", None, None, _levels(counts))]
                context, numbers, total = _contexts(before, counts)
                if context[-1] == n_words:
                    rows.append((-2, -1, 0, "start", None, None, numbers[-1].tolist()))
                    context, numbers, total = context[:-1], numbers[:-1], total[:-1]
                rows += _by_word_shard(words, "middle", context, np.column_stack([total, numbers]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FACTS, strict=True)], schema=FACTS)

    return run


def _middle_finished(folder: str, cuts: tuple) -> Callable:
    """What the pairs that begin with a word count in the middle of triples, and the mass it leaves there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                middle = _large(packed).reshape(-1, 4)
                write_array(folder, f"{shard}.middle", middle[:, 0])
                # The end is no context
                write_array(folder, f"{shard}.middle_gamma", middle[:, 1:] @ np.array(cuts) / np.maximum(1, middle[:, 0]))
            yield pa.RecordBatch.from_arrays([batch.column("shard")], names=["shard"])

    return run


def _totals(facts: DataFrame) -> dict[str, list[int]]:
    totals = facts.groupBy("kind").agg(*[F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(4)])
    return {r["kind"]: [r[f"t{k}"] or 0 for k in range(4)] for r in totals.collect()}


def _summed_facts(facts: DataFrame, words: SortedKeys, kinds: dict[str, int], summary: str) -> DataFrame:
    return settle(facts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_word_facts(words, kinds, summary), FACTS_DDL), f"{summary}-facts")


def _train_triples(texts: DataFrame, known: Words, pairs: NarrowKeys, n_tokens: int, n_texts: int) -> Triples:
    """Triples of all texts, and the arrays by pair and by word that the model of triples adds."""
    spark, words = texts.sparkSession, known.keys
    n_words, word_bits, pair_bits = len(words), _width(len(words)), _width(len(pairs))
    if word_bits + pair_bits > 64:
        raise OverflowError("places of pairs and ids of words take more than 64 bits")
    folder, bits = new_folder(spark, "triples"), min(pair_bits, _bits(n_tokens, PAIRS_A_SHARD))
    triples = Triples(NarrowKeys(folder, bits, pair_bits + word_bits, np.zeros(1 << bits, np.int64)), word_bits)

    def triples_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, piece in text_pieces([batch], limit=SCORED_BYTES):
            hashes, starts = tokens(piece)
            ids = known.of(hashes, {})[0]
            distinct, back = np.unique(pair_keys(ids, starts, n_words), return_inverse=True)
            later = np.ones(len(ids), bool)
            later[starts[:-1]] = False
            at = np.flatnonzero(later)
            yield triples.key(pairs.places(distinct)[back[at - 1]], ids[at])

    counted = count_keys(texts, triples_of, bits, triples.keys.width).mapInArrow(_triple_shards(triples), TRIPLES_DDL)
    shards = counted.collect()  # a row a shard
    triples = Triples(NarrowKeys(folder, bits, triples.keys.width, _sizes(shards, bits)), word_bits)
    every = spark.range(0, 1 << bits, 1, max(1, (1 << bits) // SHARDS_A_TASK)).select(F.col("id").cast("int").alias("shard"))
    counted = count_keys(every, _last_pairs(pairs, triples, n_words), bits, pair_bits).mapInArrow(_tokens_before(triples, len(pairs)), TRIPLES_DDL)
    triples.counted = frozenset(r["shard"] for r in counted.select("shard").collect())  # a row a block
    every = spark.range(0, 1 << pairs.bits, 1, max(1, (1 << pairs.bits) // SHARDS_A_TASK)).select(F.col("id").cast("int").alias("shard"))
    facts = _summed_facts(every.mapInArrow(_middle_facts(pairs, triples, words), FACTS_DDL), words, {"middle": 4}, "middles")
    by_kind = _totals(facts)
    triples.cuts, triples.middle = discounts(*np.sum([r["total"] for r in shards] or [[0] * 4], axis=0).tolist()), discounts(*by_kind["pairs"])
    triples.start_gamma = float(np.dot(triples.middle, by_kind["start"][:3])) / n_texts
    finish = facts.filter("kind = 'middles'").select("shard", "numbers").mapInArrow(_middle_finished(words.folder, triples.middle), "shard int")
    finish.write.format("noop").mode("overwrite").save()
    return triples


def train(docs: DataFrame) -> Model:
    """The models of all rows of ``docs`` (``text``)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    folder, bits = new_folder(spark, "words"), _bits(size["bytes"], WORDS_A_SHARD)

    def words_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, piece in text_pieces([batch]):
            yield tokens(piece)[0]

    counted = count_keys(texts, words_of, bits).mapInArrow(_word_shards(folder, bits), "shard int, n long, tokens long")
    shards = counted.collect()  # a row a shard
    words, n_tokens = SortedKeys(folder, bits, _sizes(shards, bits)), sum(r["tokens"] for r in shards)
    n_words = len(words)
    if n_words >= 1 << 32:
        raise OverflowError("more than 2 ** 32 different words")
    pair_folder, width = new_folder(spark, "pairs"), _width(n_words * (n_words + 1))
    if not n_tokens:
        none = NarrowKeys(pair_folder, 0, width, np.zeros(1, np.int64))
        return Model(Words(words), none, Triples(none, 0), 0, 0, (0.5, 0.5, 0.5), 0.0, 1.0)
    known, pair_bits = Words(words), min(width, _bits(n_tokens, PAIRS_A_SHARD))

    def pairs_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, piece in text_pieces([batch]):
            hashes, starts = tokens(piece)
            yield pair_keys(known.of(hashes, {})[0], starts, n_words)

    pairs = count_keys(texts, pairs_of, pair_bits, width).mapInArrow(_pair_shards(pair_folder, pair_bits, width, words), FACTS_DDL)
    facts = _summed_facts(pairs, words, {"after": 1, "before": 3}, "words")
    by_kind = _totals(facts)
    sizes = facts.filter("kind = 'pairs'").select(F.col("pair_shard").alias("shard"), "n").collect()  # a row a shard
    keys = NarrowKeys(pair_folder, pair_bits, width, _sizes(sizes, pair_bits))
    cuts, lower = discounts(*by_kind["pairs"]), discounts(*by_kind["words"])
    # Words by the number of words before them: 1, 2, more (the total of more is what is left of all words)
    once, twice = by_kind["words"][:2]
    free = float(np.dot(lower, [once, twice, n_words - once - twice])) / len(keys)
    finish = facts.filter("kind = 'words'").select("shard", "numbers").mapInArrow(_finished(folder, words, cuts, lower, len(keys), free), "shard int")
    finish.write.format("noop").mode("overwrite").save()
    gamma = float(np.dot(cuts, by_kind["start"][:3])) / size["n"]
    triples = _train_triples(texts, known, keys, n_tokens, size["n"])
    return Model(known, keys, triples, n_tokens, size["n"], cuts, gamma, free / (n_words + 1))


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_())]
    + [(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")]
    + [(c, pa.float64()) for c in ("base_score", "score", "triple_score")]
)
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, triple_score double"


def _found(stored: NarrowKeys, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (-1: unknown) and counts of sorted keys of pairs or of triples."""
    places, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    for shard, part, at, there in stored.parts(keys):
        if there.any():
            places[part] = np.where(there, at + stored.starts[shard], -1)
            counts[part] = np.where(there, read_counts(stored.folder, f"{shard}.count", at), 0)
    return places, counts


def _distinct(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different ones of the valid keys, and the place among them of each key (-1: not valid)."""
    back = np.full(len(keys), -1, np.int64)
    distinct, back[valid] = np.unique(keys[valid], return_inverse=True)
    return distinct, back


def _shifted(values: np.ndarray, starts: np.ndarray, start: float) -> np.ndarray:
    """The value of the token before each token; ``start`` at the start of a text."""
    out = np.empty(len(values), values.dtype)
    out[1:] = values[:-1]
    out[starts[:-1]] = start
    return out


def _mixed(seen: np.ndarray, total: np.ndarray, gamma: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted counts over their total and the rest by the lower order; the lower order alone where nothing was counted."""
    heard = total > 0
    return np.where(heard, np.divide(seen, total, out=np.zeros(len(seen)), where=heard) + gamma * lower, lower)


def all_probabilities(model: Model, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training count of every token, its probability under the model of pairs and under that of triples."""
    columns = {"count": "<i8", "alone": "<f8", "gamma": "<f8", "middle": "<i8", "middle_gamma": "<f8"}
    ids, found = model.words.of(hashes, columns)
    known, first, triples = ids >= 0, starts[:-1], model.triples
    alone = np.where(known, found["alone"], model.unknown)
    context = _shifted(found["count"], starts, model.n_texts)
    distinct, pair = _distinct(pair_keys(ids, starts, max(1, len(model.words.keys))), known & (context > 0))
    # One more entry at the end, -1, for what is no pair
    places, many = (np.append(x, none) for x, none in zip(_found(model.pairs, distinct), (-1, 0), strict=True))
    counts = many[pair]
    pairs = _mixed(_less(counts, model.cuts), context, _shifted(found["gamma"], starts, model.start_gamma), alone)

    there, before = np.flatnonzero(places >= 0), np.zeros(len(places), np.int64)
    before[there] = triples.before(places[there])
    before = before[pair]
    before[first] = counts[first]
    total = _shifted(found["middle"], starts, model.n_texts)
    middle = _mixed(_less(before, triples.middle), total, _shifted(found["middle_gamma"], starts, triples.start_gamma), alone)

    begin = _shifted(pair, starts, -1)
    begins = np.zeros(len(places), bool)
    begins[begin] = True
    begins, gamma = np.flatnonzero(begins & (places >= 0)), np.zeros(len(places))
    gamma[begins] = triples.classes(places[begins]) @ np.array(triples.cuts) / many[begins]
    distinct, triple = _distinct(triples.key(places[begin], ids), known & (places[begin] >= 0))
    counts = np.append(_found(triples.keys, distinct)[1], 0)[triple]
    return found["count"], pairs, _mixed(_less(counts, triples.cuts), many[begin], gamma[begin], middle)


def token_probabilities(model: Model, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count and probability under the model of pairs of every token."""
    return all_probabilities(model, hashes, starts)[:2]


def _scored(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches, limit=SCORED_BYTES):
            hashes, starts = tokens(texts)
            counts, *found = all_probabilities(model, hashes, starts)
            base = np.log10((counts + 1) / (model.n_tokens + len(model.words.keys) + 1))
            logs = [np.log10(p) for p in found]
            bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            values = [
                piece.column("doc_id"),
                piece.column("held_out"),
                np.diff(starts),
                np.add.reduceat((counts > 0).astype(np.int64), starts[:-1]),
                np.full(len(bounds), model.n_tokens),
                # Exact sums: the same whatever a text is scored together with
                *[np.array([math.fsum(part[a:b].tolist()) for a, b in bounds]) for part in (base, *logs)],
            ]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, SCORES, strict=True)], schema=SCORES)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Tokens, known tokens and log10 probabilities of every text of ``docs``; ``perplexity`` is a token's under the model of pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(_scored(model), SCORES_DDL)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_documents(docs: DataFrame) -> DataFrame:
    """All texts, by the models of those that are not held out."""
    return score(docs, train(docs.filter(~held_out())))

"""Packing documents into sequences of a fixed number of tokens by bin completion.

Only lengths matter for a packing, and there are at most ``capacity`` of them.
So the documents are reduced to a histogram of piece lengths (one row a length:
a bounded table), the search runs on that histogram, and its result is a short
list of patterns: which lengths make up a sequence, and how many such sequences
there are. Pieces then take the places of their length in order of their rank,
which is counted in parallel.

Search: around the largest length left, undominated fillings of the rest of the
sequence are enumerated, least waste first; a branch ends when its waste alone
rules out fewer sequences than the incumbent. The incumbent is best-fit
decreasing. A filling is applied to as many sequences at once as the counts
allow, or half as many and so on, so depth does not grow with the number of
documents. Rounds allow more and more choices beside the first ones, so all
packings are reached in the end. ``node_budget`` bounds the search; what it
returns is always a whole packing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnokit.llm.batches import text_pieces
from limnokit.llm.subwords import cached_tokenizer, tokenizer_path
from limnokit.session import settle

#: A pattern: lengths of a sequence, largest first, and the number of such sequences.
Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces too long to share one."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for small in range(1, capacity // 2 + 1):
        large = sum(n for k, n in counts.items() if k > capacity - small)
        middle = [(k, n) for k, n in counts.items() if capacity - small >= k > capacity // 2]
        fill = sum(k * n for k, n in counts.items() if small <= k <= capacity // 2)
        halves = sum(n for _, n in middle)
        room = sum((capacity - k) * n for k, n in middle)
        best = max(best, large + halves + max(0, -(-(fill - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram; open sequences of one make are handled together."""
    room: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(left: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if left not in open_:
                open_[left] = []
                insort(room, left)
            open_[left].append([lengths, n])

    for k in sorted(counts, reverse=True):
        todo = counts[k]
        while todo:
            i = bisect_left(room, k)
            if i == len(room):
                fit = capacity // k
                put(capacity - fit * k, (k,) * fit, todo // fit)
                put(capacity - (todo % fit) * k, (k,) * (todo % fit), int(todo % fit > 0))
                break
            left = room[i]
            lengths, n = open_[left].pop()
            if not open_[left]:
                del open_[left]
                room.pop(i)
            fit = left // k
            full = min(n, todo // fit)
            part = 0 if full == n else todo - full * fit
            put(left - fit * k, lengths + (k,) * fit, full)
            if part:
                put(left - part * k, lengths + (k,) * part, 1)
            put(left, lengths, n - full - int(part > 0))
            todo -= full * fit + part
    return [(lengths, n) for makes in open_.values() for lengths, n in makes]


def fillings(lengths: list[int], counts: Counter, rest: int, width: int) -> tuple[list[tuple[int, ...]], int, bool]:
    """Undominated multisets of ``lengths`` (ascending, all counted) that fit in ``rest``, least waste first.

    Where a piece fits, whatever takes its place must fill more than it does:
    smaller pieces that together are no longer can change places with it.
    Returns the fillings, the steps taken, and whether ``width`` cut anything:
    it bounds the pieces tried at a place, the fillings, and the steps (16 times).
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps, cut = 0, False

    def grow(chosen: tuple[int, ...], top: int, left: int, need: int) -> None:
        nonlocal steps, cut
        i = min(bisect_right(lengths, left) - 1, top)
        tried = 0
        while i >= 0 and need < rest:
            k = lengths[i]
            if chosen.count(k) < counts[k]:
                if tried == width or steps == 16 * width:
                    cut = True
                    return
                steps += 1
                tried += 1
                grow((*chosen, k), i, left - k, need)
                need = max(need, rest - left + k)
            i -= 1
        if not tried and rest - left > need:
            found.append((rest - left, chosen))

    grow((), len(lengths) - 1, rest, -1)
    unique = dict.fromkeys(sorted(found, key=lambda x: (-x[0], len(x[1]), x[1])))
    return [x for _, x in unique][:width], steps, cut or len(unique) > width


def _repetitions(most: int) -> list[int]:
    """``most`` halved down to 1; steps of these sizes add up to any number."""
    out = [most]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return out


def _search(
    counts: dict[int, int], capacity: int, best_n: int, bound: int, budget: int, width: int, allowed: int
) -> tuple[list[Pattern] | None, int, bool]:
    """One round: the best packing below ``best_n`` sequences, or None, the nodes spent, and whether nothing was left out.

    At most ``allowed`` of the choices on a path may differ from the first one
    of their node: the filling of least waste, as often as it can be.
    """
    best, whole, nodes = None, True, 0
    left, path = Counter(counts), []
    seen: dict[int, tuple[int, int]] = {}

    def choices() -> list[tuple[tuple[int, ...], int]]:
        nonlocal nodes, whole
        lengths = sorted(left)
        top = lengths[-1]
        left[top] -= 1
        if not left[top]:
            lengths.pop()
        rests, steps, cut = fillings(lengths, left, capacity - top, width)
        left[top] += 1
        nodes += 1 + steps // 192
        whole = whole and not cut
        patterns = [(top, *x) for x in rests]
        most = [min(left[k] // n for k, n in Counter(x).items()) for x in patterns]
        ways = [_repetitions(n) for n in most]
        return [(x, w[0]) for x, w in zip(patterns, ways, strict=True)] + [(x, n) for x, w in zip(patterns, ways, strict=True) for n in w[1:]]

    # each frame: choices still to try, the one that was applied, sequences used before it, other choices still allowed
    stack: list[list] = [[iter(choices()), None, 0, allowed, True]]
    room = sum(k * n for k, n in counts.items())
    while stack and best_n > bound and nodes < budget:
        frame = stack[-1]
        if frame[1]:
            pattern, n = frame[1]
            for k in pattern:
                left[k] += n
            room += n * sum(pattern)
            path.pop()
            frame[1] = None
        choice = next(frame[0], None)
        if choice is None or not (frame[4] or frame[3]):
            whole = whole and choice is None
            stack.pop()
            continue
        others = frame[3] - (not frame[4])
        frame[4] = False
        pattern, n = choice
        used, rest = frame[2] + n, room - n * sum(pattern)
        if used - (-rest // capacity) >= best_n:
            continue
        for k in pattern:
            left[k] -= n
            if not left[k]:
                del left[k]
        room = rest
        frame[1] = choice
        path.append(choice)
        if not left:
            best, best_n = list(path), used
            continue
        # a state met before with no more sequences and no fewer choices has been searched
        state = hash(frozenset(left.items()))
        before = seen.get(state)
        if before and before[0] <= used and before[1] >= others:
            continue
        seen[state] = (used, others)
        stack.append([iter(choices()), None, used, others, True])
    return best, nodes, whole and not stack


def complete_bins(counts: dict[int, int], capacity: int, node_budget: int = 20_000, width: int = 12) -> list[Pattern]:
    """Patterns that use up ``counts`` (length -> pieces, lengths up to ``capacity``) in as few sequences as found.

    Rounds allow one more choice beside the first of its node each, and twice
    the ``width``, until the lower bound is met, a round left nothing out (the
    packing is then the best there is) or ``node_budget`` nodes are spent.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    allowed, spent, whole = 0, 0, False
    while sum(n for _, n in best) > bound and spent < node_budget and not whole:
        found, nodes, whole = _search(
            counts, capacity, sum(n for _, n in best), bound, node_budget - spent, width << allowed, allowed
        )
        best, spent, allowed = found or best, spent + nodes, allowed + 1
    return best


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document; only longer ones are cut.

    The first piece takes the remainder, the others are full. ``seq`` numbers
    the pieces, so that those of equal rows can be told apart once written.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = cached_tokenizer(tokenizer, True)
        seq = TaskContext.get().partitionId() << 33
        for rows, texts in text_pieces(batches):
            found = library.encode(texts)
            size = np.diff(found.bound) + 1
            ids = np.insert(found.ids.astype("<u4"), found.bound[1:], end_id)
            pieces = -(-size // capacity)
            which = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (size - 1) % capacity + 1
            start = np.where(number == 0, 0, first[which] + (number - 1) * capacity)
            length = np.where(number == 0, first[which], capacity)
            at = (np.cumsum(size) - size)[which] + start
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.record_batch(
                [rows.column("doc_id").take(pa.array(which)), pa.array(number, pa.int32()), start, length, pa.array(crc, pa.int64()), seq + np.arange(len(which))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "seq"],
            )
            seq += len(which)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, seq bigint"
    )


def place_pieces(pieces: DataFrame, capacity: int, node_budget: int = 20_000, per_bucket: int = 10_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be settled (it is read three times)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    base, places = 0, []
    ranks: Counter = Counter()
    for lengths, n in complete_bins(histogram, capacity, node_budget):
        offset = 0
        for k, times in sorted(Counter(lengths).items(), reverse=True):
            places.append((k, ranks[k], times, base, offset))
            ranks[k] += times * n
            offset += k * times
        base += n
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    # ranks among pieces of one length: position within a bucket, after all earlier buckets of that length
    n_buckets = max(1, sum(histogram.values()) // per_bucket)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "seq"), F.lit(n_buckets)).cast("int")
    keyed = pieces.withColumn("bucket", bucket)
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "seq")
    ranked = keyed.withColumn("within", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            order = rank - row[:, 1]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), row[:, 3] + order // row[:, 2], row[:, 4] + order % row[:, 2] * length],
                [*names, "sequence_id", "offset"],
            )

    return ranked.select(*names, (F.col("before") + F.col("within")).alias("rank")).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def pack_documents(
    docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, node_budget: int = 20_000
) -> DataFrame:
    """Place every document of ``docs`` (``doc_id``, ``text``) in sequences of ``capacity`` tokens.

    Null or empty texts give one piece holding the end id. Repeated rows and
    repeated or null ids are packed like any others; an empty table gives no
    piece. Other columns are ignored.
    """
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    return place_pieces(settle(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, node_budget)

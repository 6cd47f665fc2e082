"""Repair of damaged conversations at the least cost, by dynamic programming over a grammar.

A row of a conversation is one symbol: the class of its role (system, user,
assistant, other) with its fault (none, blank, duplicate, truncated). Any run
of symbols is a 4 x 4 matrix in the min-plus sense: from and to each state of
the wanted order (nothing yet, after a system, a user, an assistant turn), the
least cost and, among the cheapest, the least audit text. Runs that occur
often are computed once: Re-Pair replaces the most frequent pair of symbols by
a rule until no pair occurs twice, a rule's matrix is the product of its two
parts, and its audit is a rope of theirs. Equal runs of different conversations
meet before that, so each is evaluated once.

A conversation is cut into runs of at most ``RUN`` rows. Runs of one
conversation are evaluated wherever they fall and only then multiplied in
order, so a conversation that holds a third of all rows is many runs, not one
task. Equal rows (same turn, role and text) are summed before they are moved.
Only the hash of the repaired text, which SHA-256 makes a chain, is read in
order by one task, as a stream.

Null ids, turns, roles and texts read as one space. Rows come by turn, nulls
first; rows of one turn by the first 16 bytes of the SHA-256 of role and text.
Rows without a conversation id are one conversation with a null id. Columns
other than ``conv_id``, ``turn``, ``role`` and ``text`` are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit.llm.batches import text_pieces
from limnokit.operators.joins import null_safe_join
from limnokit.operators.ordered import with_row_position
from limnokit.session import settle

#: Rows of a conversation in one run, the unit of work.
RUN = 2048
#: Symbols that share one grammar.
GRAMMAR = 1 << 17

WHITE = " \t\n\x0b\x0c\r"
ROLES, FAULTS = ("s", "u", "a", "other"), ("none", "blank", "duplicate", "truncated")
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
USER_FROM, ASSISTANT_FROM = (START, AFTER_S, AFTER_A), (AFTER_U,)
KEEP = {0: ((START, AFTER_S),), 1: tuple((i, AFTER_U) for i in USER_FROM), 2: tuple((i, AFTER_A) for i in ASSISTANT_FROM), 3: ()}
LEGAL = {(0, 1), (1, 2), (2, 1)}


@dataclass(frozen=True)
class Costs:
    """What an edit costs; keeping is free. ``insert`` must be above 0, or equal costs could hide endless repairs."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# --- matrices of costs and audits ---------------------------------------------


class Rope:
    """Text in two parts that is only joined when it is asked for."""

    __slots__ = ("left", "right", "joined")

    def __init__(self, left: Rope | None, right: Rope | None, joined: str | None = None) -> None:
        self.left, self.right, self.joined = left, right, joined

    def text(self) -> str:
        if self.joined is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.joined is None:
                    todo += (rope.right, rope.left)
                else:
                    parts.append(rope.joined)
            self.joined, self.left, self.right = "".join(parts), None, None
        return self.joined


Entry = tuple[int, Rope]
Matrix = list[Entry | None]


def _better(new: Entry, old: Entry | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1].text() < old[1].text())


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least cost, then least audit, over every state between the two. Either may be a row of 4."""
    out: Matrix = [None] * len(a)
    for at, left in enumerate(a):
        if left is None:
            continue
        row, k = at - at % 4, at % 4
        for j in range(4):
            right = b[4 * k + j]
            if right is None:
                continue
            cost, old = left[0] + right[0], out[row + j]
            if old is None or cost <= old[0]:
                new = (cost, Rope(left[1], right[1]))
                if _better(new, old):
                    out[row + j] = new
    return out


def _of_moves(moves: Iterable[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [None] * 16
    for i, j, cost, letter in moves:
        new = (cost, Rope(None, None, letter))
        if _better(new, out[4 * i + j]):
            out[4 * i + j] = new
    return out


def insertions(costs: Costs) -> Matrix:
    """Any number of inserted turns: the cheapest chains between the states."""
    one = [(i, AFTER_U, costs.insert, "I") for i in USER_FROM] + [(i, AFTER_A, costs.insert, "I") for i in ASSISTANT_FROM]
    step = _of_moves([(i, i, 0, "") for i in range(4)] + one)
    chain = step
    for _ in range(2):
        chain = product(chain, step)
    return chain


def symbol_matrix(symbol: int, costs: Costs) -> Matrix:
    """One row, after any inserted turns."""
    role, fault = divmod(symbol, 4)
    moves = [(i, i, costs.delete, "D") for i in range(4)]
    if FAULTS[fault] in ("none", "truncated"):
        more = costs.truncated if FAULTS[fault] == "truncated" else 0
        moves += [(i, j, more, "K") for i, j in KEEP[role]]
        moves += [(i, AFTER_U, costs.rerole + more, "R") for i in USER_FROM]
        moves += [(i, AFTER_A, costs.rerole + more, "R") for i in ASSISTANT_FROM]
    return product(insertions(costs), _of_moves(moves))


# --- the grammar -----------------------------------------------------------------


def re_pair(sequences: list[bytes]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (rule ``k`` is symbol ``16 + k``) and every sequence in terms of them.

    The most frequent pair becomes a rule until none occurs twice. Sequences
    hold symbols as letters from ``A``; no pair crosses from one to the next.
    """
    symbols: list[int] = []
    for sequence in sequences:
        symbols.extend(b - 65 for b in sequence)
        symbols.append(-1)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        if symbols[i] >= 0 and symbols[i + 1] >= 0:
            places.setdefault((symbols[i], symbols[i + 1]), set()).add(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        now = len(places.get(pair, ()))
        if now < 2:
            continue
        if now != -count:
            heapq.heappush(heap, (-now, pair))
            continue
        a, b = pair
        new, touched, used = 16 + len(rules), set(), False
        for i in sorted(places.pop(pair)):
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            p, k = before[i], after[j]
            if p >= 0 and symbols[p] >= 0:
                places.get((symbols[p], a), set()).discard(p)
                places.setdefault((symbols[p], new), set()).add(p)
                touched.add((symbols[p], new))
            if k < n and symbols[k] >= 0:
                places.get((b, symbols[k]), set()).discard(j)
                places.setdefault((new, symbols[k]), set()).add(i)
                touched.add((new, symbols[k]))
            symbols[i], symbols[j], after[i], used = new, -2, k, True
            if k < n:
                before[k] = i
        if used:
            rules.append(pair)
        for other in touched:
            if len(places.get(other, ())) > 1:
                heapq.heappush(heap, (-len(places[other]), other))
    out: list[list[int]] = []
    i, one = 0, []
    while i < n:
        if symbols[i] == -1:
            out.append(one)
            one = []
        else:
            one.append(symbols[i])
        i = after[i]
    return rules, out


@dataclass(slots=True)
class Tally:
    """Faults of a run, its breaks in the order of roles, and its first and last role (-1: no row)."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: int = -1
    last: int = -1

    def then(self, other: Tally) -> Tally:
        if self.first < 0 or other.first < 0:
            return other if self.first < 0 else self
        meet = 0 if (self.last, other.first) in LEGAL else 1
        return Tally(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + meet, self.first, other.last,
        )

    def counts(self) -> list[int]:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last]


def evaluate(sequences: list[bytes], whole: list[bool], costs: Costs) -> list[tuple[Matrix, Tally]]:
    """Matrix and tally of every sequence, by one grammar for all; ``whole`` ones need only the row of the start."""
    rules, reduced = re_pair(sequences)
    known = [symbol_matrix(s, costs) for s in range(16)]
    tallies = [Tally(*(int(FAULTS[s % 4] == f) for f in FAULTS[1:]), 0, s // 4, s // 4) for s in range(16)]
    for a, b in rules:
        known.append(product(known[a], known[b]))
        tallies.append(tallies[a].then(tallies[b]))
    empty: Matrix = [(0, Rope(None, None, "")) if at % 5 == 0 else None for at in range(16)]
    out = []
    for sequence, alone in zip(reduced, whole, strict=True):
        matrix, tally = empty[:4] if alone else empty, Tally()
        for symbol in sequence:
            matrix, tally = product(matrix, known[symbol]), tally.then(tallies[symbol])
        out.append((matrix, tally))
    return out


# --- on Spark -----------------------------------------------------------------------


RUNS = pa.schema(
    [("symbols", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)


def _evaluated(costs: Costs) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(runs: list[str], whole: list[bool]) -> pa.RecordBatch:
        found = evaluate([r.encode() for r in runs], whole, costs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(runs, pa.string()),
                pa.array([[None if e is None else e[0] for e in m] for m, _ in found], pa.list_(pa.int64())),
                pa.array([[None if e is None else e[1].text() for e in m] for m, _ in found], pa.list_(pa.string())),
                pa.array([t.counts() for _, t in found], pa.list_(pa.int64())),
            ],
            schema=RUNS,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, whole, held = [], [], 0
        for batch in batches:
            for symbols, alone in zip(batch.column("symbols").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                runs.append(symbols)
                whole.append(alone)
                held += len(symbols)
                if held >= GRAMMAR:
                    yield flush(runs, whole)
                    runs, whole, held = [], [], 0
        if runs:
            yield flush(runs, whole)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows under test: by a hash of id and turn some are dropped (0 copies), emptied, cut, doubled or re-roled."""
    id_, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(id_, F.lit(":"), turn)) % 20
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _digest() -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16).alias("digest")


def _symbols(role: Column, fault: Column, copies: Column) -> Column:
    """Letters of a row and of its equal copies, which are blank as it is or else duplicates."""
    again = F.when(fault == 1, F.lit(1)).otherwise(F.lit(2))

    def letter(of: Column) -> Column:
        return F.char(role * 4 + of + 65)

    return F.when(copies > 0, F.concat(letter(fault), F.repeat(letter(again), (copies - 1).cast("int")))).otherwise(F.lit(""))


def _light_rows(rows: DataFrame) -> DataFrame:
    """One small row per distinct row: its symbols and whether the same was said in an earlier turn."""
    core = F.rtrim("text", F.lit(WHITE))
    blank, cut = core == "", ~F.right(core, F.lit(1)).isin(".", "!", "?")
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    light = rows.select("conv_id", "turn", _digest(), "copies", role.alias("role"), F.when(blank, 1).when(cut, 3).otherwise(0).alias("fault"))
    light = light.groupBy("conv_id", "turn", "digest").agg(F.sum("copies").alias("copies"), F.min("role").alias("role"), F.min("fault").alias("fault"))
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    said = light.filter((F.col("copies") > 0) & (F.col("fault") != 1)).groupBy("conv_id", "digest").agg(F.min(when).alias("__first"), F.count(F.lit(1)).alias("__turns"))
    marked = null_safe_join(light, said.filter("__turns > 1").drop("__turns"), ["conv_id", "digest"], "left")
    fault = F.when((F.col("fault") != 1) & (when > F.col("__first")), 2).otherwise(F.col("fault"))
    return marked.select("conv_id", "turn", "digest", "copies", _symbols(F.col("role"), fault, F.col("copies")).alias("symbols"))


def _runs(light: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """Runs of symbols in order, and the gaps of each conversation."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    placed = settle(with_row_position(light, order, "place"), "turns")
    said = F.when(F.col("copies") > 0, F.col("turn"))
    spans = placed.groupBy("conv_id").agg(F.min("place").alias("__start"), F.count(F.lit(1)).alias("__rows"), F.max(F.length("symbols")).alias("__most"), F.max(said).alias("__max"), F.min(said).alias("__min"), F.count_distinct(said).alias("__turns"))
    spans = settle(spans, "conversation-spans")
    gaps = spans.select("conv_id", F.coalesce(F.col("__max") - F.col("__min") + 1 - F.col("__turns"), F.lit(0)).cast("long").alias("gaps"))
    cut = null_safe_join(placed, spans.select("conv_id", "__start", "__rows"), ["conv_id"], "inner").withColumn("slice", F.floor((F.col("place") - F.col("__start")) / run))
    parts = cut.groupBy("conv_id", "slice").agg(F.array_sort(F.collect_list(F.struct("place", "symbols"))).alias("parts"), F.max("__rows").alias("__rows"))
    joined = parts.withColumn("all", F.array_join(F.transform("parts", lambda p: p["symbols"]), ""))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("all") / run) - 1, F.lit(0)).cast("int"))
    whole = (F.col("__rows") <= run) & (F.length("all") <= run)
    split = joined.select("conv_id", "slice", "all", whole.alias("whole"), F.explode(pieces).alias("piece"))
    return split.select("conv_id", "slice", "piece", "whole", F.substring(F.col("all"), F.col("piece") * run + 1, F.lit(run)).alias("symbols")), gaps


OUT = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [(c, pa.string()) for c in ("audit", "repaired_sha256")]
)
OUT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """Multiplies the runs of one conversation in order, then walks its rows along the audit."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.gaps, self.tally, self.audit, self.at = conv_id, 0, Tally(), None, 0
        self.states: Matrix = [(0, Rope(None, None, "")), None, None, None]
        self.sha, self.state, self.written = hashlib.sha256(), START, False

    def run(self, costs: list[int | None], audits: list[str | None], counts: list[int]) -> None:
        matrix: Matrix = [None if c is None else (c, Rope(None, None, a)) for c, a in zip(costs, audits, strict=True)]
        self.states = product(self.states, matrix + [None] * (16 - len(matrix)))
        self.tally = self.tally.then(Tally(*counts))

    def settle(self, closing: Matrix) -> None:
        best = None
        for at, entry in enumerate(product(self.states, closing)):
            if at in ENDS and entry is not None and _better(entry, best):
                best = entry
        self.cost, self.audit = best[0], best[1].text()

    def _emit(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.written else "").encode() + f"{role}:{text}".encode())
        self.written = True

    def _next(self) -> str:
        """The role that the order wants where one is inserted or changed."""
        return "assistant" if self.state == AFTER_U else "user"

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(self._next(), "")
            self.state = AFTER_A if self.state == AFTER_U else AFTER_U
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                continue
            said = self._next() if edit == "R" else role
            self._emit(said, text)
            self.state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[said[0]]

    def result(self) -> tuple:
        self.inserted()
        t = self.tally
        return (self.conv_id, self.gaps, t.blank, t.duplicate, t.truncated, t.illegal, self.cost, self.audit, self.sha.hexdigest())


def _repaired(costs: Costs) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams runs (kind 0 and 1) and then rows (kind 2) of each conversation."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing, now, done, held = insertions(costs), None, [], 0
        for piece, texts in text_pieces(batches):
            columns = [piece.column(c).to_pylist() for c in ("conv_id", "kind", "copies", "role", "costs", "audits", "counts")]
            for conv_id, kind, copies, role, cost, audits, counts, text in zip(*columns, texts.to_pylist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                        held += len(now.audit)
                        if held > 1 << 20 or len(done) >= 1 << 12:
                            yield out(done)
                            done, held = [], 0
                    now = _Conversation(conv_id)
                if kind == 0:
                    now.gaps = copies
                elif kind == 1:
                    now.run(cost, audits, counts)
                else:
                    if now.audit is None:
                        now.settle(closing)
                    now.row(role, text, copies)
        if now is not None:
            done.append(now.result())
        if done:
            yield out(done)

    return run


def repair_conversations(rows: DataFrame, costs: Costs = Costs(), run: int = RUN) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every conversation.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` (the last two not
    null) and ``copies``: how often a row stands there; 0 keeps the id only.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("long").alias("copies"))
    pieces, gaps = _runs(_light_rows(rows), run)
    pieces = settle(pieces, "runs")
    distinct = pieces.groupBy("symbols").agg(F.min("whole").alias("whole")).repartitionByRange("symbols").sortWithinPartitions("symbols")
    schema = "symbols string, costs array<long>, audits array<string>, counts array<long>"
    known = settle(distinct.mapInArrow(_evaluated(costs), schema), "run-matrices")
    runs = pieces.join(known, "symbols").select("conv_id", F.lit(1).alias("kind"), F.col("slice").cast("long").alias("a"), F.col("piece").cast("long").alias("b"), "costs", "audits", "counts")
    heads = gaps.select("conv_id", F.lit(0).alias("kind"), F.col("gaps").alias("copies"))
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", _digest(), "copies", "role", "text")
    stream = heads.unionByName(runs, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "a", "b", "turn", "digest")]
    dealt = stream.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "kind", "copies", "role", "text", "costs", "audits", "counts").mapInArrow(_repaired(costs), OUT_DDL)

"""The trie of all conversations by their turns, from adaptive radix trees.

A turn's id is 16 bytes of the SHA-256 of its role and text, so a conversation
is a byte key of fixed-width ids, and a node of the trie is a place in a radix
tree whose byte depth is a multiple of that width; other depths give nothing.

Equal keys are counted before they are moved, so copies are one key. The
distinct keys are sorted by range over all tasks and cut into blocks, each of
which becomes a radix tree. A block knows how many turns its first key shares
with the last key of the block before and its last key with the first one
after. A node that two blocks share counts its own repeats in the first of
them, so sums over blocks are exact and only the few nodes along the cuts are
summed; all other rows are final where they are made.

Conversations longer than ``SLICE`` turns are cut into slices. A slice of
level k is a key below the hash of all turns before it. Levels are built from
the deepest up, each handing its sums to the nodes that it hangs from, so the
length of a key is bounded and no conversation is in one row.

A null role or text is the empty text. Rows of a conversation come by turn,
nulls first, then by turn id; equal rows are turns of their own. Rows without
a conversation id belong to no conversation; remainders of negative ids are not
negative. Other columns are ignored. An empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnokit.llm.radix import Node, insert
from limnokit.operators.ordered import with_row_position
from limnokit.session import settle

WIDTH = 16
#: Turns in one key.
SLICE = 1024
#: Keys, and bytes of keys, of one radix tree.
BLOCK_KEYS, BLOCK_BYTES = 4096, 1 << 20
#: Conversations whose first turns come from the one that heads their group.
GROUP, HEADS = 20, 4

TOP = bytes(WIDTH)


# --- conversations as keys ------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``id`` and ``words`` of every turn, and nothing of its text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    id_ = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), id_.alias("id"), words.cast("long").alias("words"))
    # Rows that are equal in all else are told apart, so that any number of them can be dealt to many tasks
    order = [*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "id")), F.col("salt").asc()]
    placed = settle(with_row_position(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), order, "place"), "turn-places")
    first = settle(placed.groupBy("conv_id").agg((F.min("place") - 1).alias("before")), "turn-starts")
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("before")).alias("pos"), "id", "words")


def regrouped(turns: DataFrame) -> DataFrame:
    """Every conversation with the first turns of the one that heads its group; all conversations have a ``pos`` 0 row."""
    turns = settle(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    sizes = settle(sizes.select("conv_id", "n", taken.alias("taken"), (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("head")), "turn-counts")
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    plan = settle(sizes.join(heads, "head", "left").select("conv_id", "head", "taken", F.least("taken", F.coalesce("n_head", F.lit(0))).alias("kept")), "turn-plan")
    own = turns.join(plan.select("conv_id", "taken", "kept"), "conv_id").filter(F.col("pos") > F.col("taken"))
    own = own.select("conv_id", (F.col("pos") - F.col("taken") + F.col("kept")).alias("pos"), "id", "words")
    lent = turns.filter((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "head")
    lent = lent.join(plan.select("conv_id", "head", "taken"), "head").filter(F.col("pos") <= F.col("taken"))
    none = plan.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(lent.select("conv_id", "pos", "id", "words")).unionByName(none)


def node_name(start: Column, ids: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(start, ids), 256)), 1, WIDTH)


def _slices(turns: DataFrame, length: int) -> DataFrame:
    """``conv_id``, ``level``, ``ids``, ``words``, and ``start``, the hash of what comes before."""
    level = F.greatest(F.floor((F.col("pos") - 1) / length), F.lit(0)).cast("int").alias("level")
    parts = turns.groupBy("conv_id", level).agg(F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "id", "words")))).alias("parts"))
    cut = parts.select(
        "conv_id", "level", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["id"])), "")).alias("ids"), F.transform("parts", lambda p: p["words"]).alias("words")
    )
    cut = settle(cut, "slices")
    marks = cut.select("conv_id", "level", *[F.xxhash64("ids", "level", F.lit(k)).alias(f"m{k}") for k in (1, 2)])
    ahead = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    xor = [F.lpad(F.hex(F.bit_xor(f"m{k}").over(ahead)), 16, "0") for k in (1, 2)]
    after = Window.partitionBy("conv_id").orderBy("level")
    starts = marks.select("conv_id", "level", F.when(F.col("level") == 0, F.lit(TOP)).otherwise(F.unhex(F.concat(*xor))).alias("start"))
    starts = starts.withColumn("next", F.lead("start").over(after))
    return settle(cut.join(starts, ["conv_id", "level"]), "started-slices")


# --- blocks of sorted keys ------------------------------------------------------


PER_KEY = {"n": "long", "low": "long", "children": "long", "leaves": "long", "saved": "long"}
BLOCK_DDL = "part int, no int, left_shared int, right_shared int, first binary, last binary, keys array<binary>, words array<array<long>>, " + ", ".join(f"{c} array<long>" for c in PER_KEY)
_LISTS = {"keys": pa.list_(pa.binary()), "words": pa.list_(pa.list_(pa.int64()))} | {c: pa.list_(pa.int64()) for c in PER_KEY}
BLOCK = pa.schema(
    [(c, pa.int32()) for c in ("part", "no", "left_shared", "right_shared")] + [(c, pa.binary()) for c in ("first", "last")] + list(_LISTS.items())
)


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns in common to two keys below the same start; -1 without a key or below different ones."""
    if a is None or b is None or a[:WIDTH] != b[:WIDTH]:
        return -1
    low, high = 0, min(len(a), len(b)) // WIDTH - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[: (middle + 1) * WIDTH] == b[: (middle + 1) * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def _blocks(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, before, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def block(after: bytes | None) -> pa.RecordBatch:
            keys = [h[0] for h in held]
            left = None if no == 0 else shared_turns(before, keys[0])
            right = None if after is None else shared_turns(keys[-1], after)
            values = [part, no, left, right, keys[0], keys[-1], *map(list, zip(*held, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCK, strict=True)], schema=BLOCK)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "words", *PER_KEY)], strict=True):
                if held and (len(held) >= most or size > BLOCK_BYTES):
                    yield block(row[0])
                    before, held, size, no = held[-1][0], [], 0, no + 1
                held.append(row)
                size += len(row[0])
        if held:
            yield block(None)

    return run


# --- one block --------------------------------------------------------------------


NODE_DDL = "start binary, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, cut boolean, parent_cut boolean"
NODE = pa.schema(
    [(c, pa.binary()) for c in ("start", "node", "parent")]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("cut", pa.bool_()), ("parent_cut", pa.bool_())]
)


class _Sums:
    """What the keys below a place of the radix tree come to; ``above`` is what its own edge adds to ``saved``."""

    __slots__ = ("n", "low", "fan", "leaves", "saved", "above", "depth")


def tree_nodes(start: bytes, keys: list[bytes], words: list[list[int]], facts: dict[str, list], left: int, right: int) -> Iterator[tuple]:
    """Rows ``NODE`` of the trie of ``keys`` (sorted, distinct), of which the first shares ``left`` and the last ``right`` turns with the neighbours."""
    root: Node | None = None
    for number, key in enumerate(keys):
        root = insert(root, key, number)
    last = len(keys) - 1

    def repeats(node: Node, turn: int, n: int) -> int:
        return n - (0 if node.low == 0 and turn <= left else 1)

    # Down: byte depths; up: sums
    order, todo = [], [(root, 0)]
    sums: dict[int, _Sums] = {}
    while todo:
        node, top = todo.pop()
        depth = top + len(node.prefix)
        order.append((node, top, depth))
        todo += [(kid, depth + 1) for _, kid in node.children()]
    for node, top, depth in reversed(order):
        s = sums[id(node)] = _Sums()
        s.n = s.fan = s.leaves = s.saved = 0
        s.low, s.depth, bare = None, depth, True
        for _, kid in node.children():
            k, bare = sums[id(kid)], False
            s.n += k.n
            s.low = k.low if s.low is None else min(s.low, k.low)
            s.leaves += k.leaves
            s.saved += k.saved + k.above
            s.fan += 1 if k.depth // WIDTH > depth // WIDTH else k.fan
        if node.end >= 0:
            at = node.end
            s.n += facts["n"][at]
            s.low = facts["low"][at] if s.low is None else min(s.low, facts["low"][at])
            if facts["children"][at]:
                s.fan, s.leaves, s.saved = facts["children"][at], facts["leaves"][at], facts["saved"][at]
            elif bare and not (at == last and right == depth // WIDTH):
                s.leaves = 1
        turns = range((top - 1) // WIDTH + 1 if top else 1, depth // WIDTH + 1)
        s.above = sum(repeats(node, t, s.n) * words[node.low][t - 1] for t in turns)

    # Down again: a row for every turn-aligned place of an edge
    hashes = {id(root): (hashlib.sha256(start), 0, None)}
    for node, top, depth in order:
        s, (sha, done, parent) = sums[id(node)], hashes.pop(id(node))
        key, saved = keys[node.low], s.saved + s.above
        first = (top - 1) // WIDTH + 1 if top else 0
        for turn in range(first, depth // WIDTH + 1):
            sha.update(key[done : turn * WIDTH])
            done = turn * WIDTH
            name = sha.digest()[:WIDTH]
            fan = s.fan if turn == depth // WIDTH else 1
            if node.low == 0 and turn < left:
                fan -= 1
            cut = (node.low == 0 and turn <= left) or (node.high == last and turn <= right)
            yield (start, name, parent and parent[0], turn, s.low, parent and parent[1], s.n, fan, s.leaves, saved, cut, bool(parent and parent[2]))
            parent = (name, s.low, cut)
            # What hangs below the next place of this edge
            saved -= repeats(node, turn, s.n) * words[node.low][turn - 1] if turn else 0
        sha.update(key[done:depth])
        for byte, kid in node.children():
            fork = sha.copy()
            fork.update(bytes([byte]))
            hashes[id(kid)] = (fork, depth + 1, parent)


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE, strict=True)], schema=NODE)

    rows: list[tuple] = []
    for batch in batches:
        for number in range(batch.num_rows):
            block = {c: batch.column(c)[number].as_py() for c in batch.schema.names}
            keys, words = block["keys"], block["words"]
            left = block["left_shared"] if block["left_shared"] is not None else shared_turns(block["last_before"], keys[0])
            right = block["right_shared"] if block["right_shared"] is not None else shared_turns(keys[-1], block["first_after"])
            bounds = [i for i in range(len(keys)) if i == 0 or keys[i][:WIDTH] != keys[i - 1][:WIDTH]] + [len(keys)]
            for low, high in zip(bounds, bounds[1:], strict=False):
                facts = {c: block[c][low:high] for c in PER_KEY}
                ids = [k[WIDTH:] for k in keys[low:high]]
                sides = (left if low == 0 else -1, right if high == len(keys) else -1)
                for row in tree_nodes(keys[low][:WIDTH], ids, words[low:high], facts, *sides):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
    if rows:
        yield out(rows)


# --- the whole trie ------------------------------------------------------------------


def _level(slices: DataFrame, below: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Partial nodes of one level, and its keys with the starts that hang from them."""
    keys = slices.groupBy(F.concat("start", "ids").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.first("words").alias("words"), F.max("next").alias("next"))
    if below is None:
        keys = keys.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
    else:
        keys = settle(keys, "keys")
        keys = keys.join(below.withColumnRenamed("start", "next"), "next", "left").fillna(0, ["children", "leaves", "saved"])
    ranged = keys.repartitionByRange("key").sortWithinPartitions("key").select("key", "words", *PER_KEY)
    blocks = settle(ranged.mapInArrow(_blocks(most), BLOCK_DDL), "blocks")
    # One row a task
    ends = blocks.filter("no = 0").select("part", "first").join(blocks.filter("right_shared IS NULL").select("part", "last"), "part")
    along = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("first_after"))
    trees = blocks.drop("first", "last").join(settle(ends, "block-ends"), "part")
    return settle(trees.mapInArrow(_trees, NODE_DDL), "nodes"), keys


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes along the cuts between blocks, summed."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("start", "parent", "depth", "parent_cut")]
    merged = nodes.filter("cut").groupBy("node").agg(*same, F.min("conv_id").alias("conv_id"), *sums)
    return settle(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("cut", F.lit(True)).select(*NODE.names), "cut-nodes")


def _end_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of one node as text, a chunk at a time."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    rows, held, size = [], [], 0
    for batch in batches:
        for node, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (held[0][0] != node or len(held) >= 1 << 14):
                rows.append((held[0][0], held[0][1], ",".join(str(c) for _, c in held)))
                size, held = size + len(rows[-1][2]), []
                if size > 1 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            held.append((node, conv_id))
    if held:
        rows.append((held[0][0], held[0][1], ",".join(str(c) for _, c in held)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _end_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, sha, rows = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                rows.append((node, sha.hexdigest()))
            node, sha = name, hashlib.sha256(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)


def _ends(slices: DataFrame) -> DataFrame:
    """Hash of the ascending ids of the conversations that end at each node."""
    last = slices.filter("next IS NULL").select(node_name(F.col("start"), F.col("ids")).alias("node"), "conv_id")
    chunks = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_end_chunks, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_end_hashes, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, length: int = SLICE, most: int = BLOCK_KEYS) -> DataFrame:
    """Every node of the trie of the conversations in ``turns`` (``conv_id, pos, id, words``; ``pos`` 0 rows only name a conversation).

    Gives ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.
    """
    slices = _slices(turns, length)
    deepest = slices.agg(F.max("level")).first()[0] or 0
    below, hanging, found = None, None, []
    for level in range(deepest, -1, -1):
        nodes, keys = _level(slices.filter(F.col("level") == level), below, most)
        if hanging is not None:
            found[-1] = (*found[-1], keys.filter("next IS NOT NULL").select(F.col("next").alias("node"), F.col("low").alias("conv_id")))
        found.append((level, nodes))
        tops = nodes.filter("depth = 0").groupBy("start").agg(*[F.sum(c).alias(n) for n, c in (("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens"))])
        below = hanging = settle(tops, "tops") if level else None
    out = None
    for level, nodes, *above in found:
        cuts = _merged(nodes)
        rows = nodes.filter("NOT cut").unionByName(cuts)
        known = cuts.select(F.col("node").alias("parent"), F.col("conv_id").alias("merged"))
        if level:
            # The top of a deeper level is a node of the level above: its members are known there
            rows = rows.filter("depth > 0").withColumns({"parent": F.when(F.col("depth") == 1, F.col("start")).otherwise(F.col("parent")), "parent_cut": F.col("parent_cut") | (F.col("depth") == 1)})
            known = known.unionByName(above[0].select(F.col("node").alias("parent"), F.col("conv_id").alias("merged")))
        easy = rows.filter("NOT parent_cut")
        fixed = rows.filter("parent_cut").join(settle(known, "cut-parents"), "parent", "left").withColumn("parent_conv_id", F.col("merged")).drop("merged")
        part = easy.unionByName(fixed).withColumn("depth", F.col("depth") + level * length)
        out = part if out is None else out.unionByName(part)
    nothing = hashlib.sha256(b"").hexdigest()
    joined = out.join(_ends(slices), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

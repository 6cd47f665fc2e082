"""Counted keys of up to 64 bits as sorted arrays in the shared folder, one file a shard and column, mapped by workers.

A shard holds the keys with the same leading bits, so the files in order are
one sorted array. Keys are spread evenly (hashes, or integers after ``spread``),
which bounds every shard by the number of shards. Tasks count what they meet
and send sorted, packed blocks; one task merges a shard and writes its files,
each under another name first, so a repeated task only writes the same again.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from limnokit.session import shared_dir

#: Keys a task counts before it sends them on.
COMBINE = 1 << 22
#: Mapped files that a worker keeps open.
OPEN_FILES = 4096

BLOCK_DDL = "shard int, n int, width int, keys binary, counts binary"
BLOCK = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of this run in the shared one; it goes when the session's file system closes."""
    path = f"{shared_dir(spark).rstrip('/')}/arrays/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return str(system.makeQualified(target).toString())


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """The bytes of ``values`` as a file that appears whole."""
    system, path = fs.FileSystem.from_uri(folder)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(draft, f"{path}/{name}")


_MAPPED: OrderedDict[tuple[str, str, str], np.ndarray] = OrderedDict()


def read_array(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file of the folder, memory-mapped where the file system allows it and read through it elsewhere."""
    found = _MAPPED.pop((folder, name, dtype), None)
    if found is None:
        system, path = fs.FileSystem.from_uri(folder)
        if isinstance(system, fs.LocalFileSystem):
            size = system.get_file_info(f"{path}/{name}").size
            found = np.memmap(f"{path}/{name}", dtype, "r").view(np.ndarray) if size else np.zeros(0, dtype)
        else:
            with system.open_input_file(f"{path}/{name}") as source:
                found = np.frombuffer(source.read_buffer(), dtype)
        if len(_MAPPED) >= OPEN_FILES:
            _MAPPED.popitem(last=False)
    _MAPPED[folder, name, dtype] = found
    return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _pack(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as steps of as few bytes as the largest one needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(width: int, n: int, packed: bytes) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(n, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def spread(x: np.ndarray, width: int) -> np.ndarray:
    """A bijection on integers of ``width`` bits that spreads the lower ones over the leading ones."""
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> half)) * np.uint64(odd) & mask
    return x ^ (x >> half)


def gather(x: np.ndarray, width: int) -> np.ndarray:
    """What ``spread`` made ``x`` of."""
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    for odd in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
        x = (x ^ (x >> half)) * np.uint64(pow(odd, -1, 1 << 64)) & mask
    return x ^ (x >> half)


def shard_of(keys: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    return (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def shard_start(shard: int, bits: int, width: int = 64) -> np.uint64:
    """The least key of a shard."""
    return np.uint64(shard) << np.uint64(width - bits) if bits else np.uint64(0)


def _counted(keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int, wide: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.searchsorted(shard_of(keys, bits, wide), np.arange((1 << bits) + 1))
        for shard in np.flatnonzero(np.diff(bounds)):
            low, high = bounds[shard], bounds[shard + 1]
            width, packed = _pack(keys[low:high] - shard_start(shard, bits, wide))
            many = counts[low:high]
            size = next(s for s in ("<u1", "<u2", "<u4", "<u8") if many.max() <= np.iinfo(s).max)
            row = [int(shard), int(high - low), width, packed, many.astype(size).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                one = summed(keys, np.ones(len(keys), np.int64))
                held.append(one)
                size += len(one[0])
                if size >= COMBINE:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= COMBINE // 2:
                        yield from blocks(*held[0])
                        held, size = [], 0
        if size:
            yield from blocks(*summed(*map(np.concatenate, zip(*held, strict=True))))

    return run


def count_keys(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int, width: int = 64) -> DataFrame:
    """Packed blocks of the counted keys (of ``width`` bits) of each batch, combined in the task, sorted by shard."""
    blocks = df.mapInArrow(_counted(keys_of, bits, width), BLOCK_DDL)
    return blocks.repartition("shard").sortWithinPartitions("shard")


def merged_shards(batches: Iterable[pa.RecordBatch], bits: int, wide: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, keys and counts of the blocks of a task, which come sorted by shard."""

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        keys, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
        return now, keys + shard_start(now, bits, wide), counts

    now, held = None, []
    for batch in batches:
        for shard, n, width, packed, counts in zip(*[batch.column(c).to_pylist() for c in BLOCK.names], strict=True):
            if held and shard != now:
                yield whole()
                held = []
            now = shard
            held.append((_unpack(width, n, packed), np.frombuffer(counts, f"<u{len(counts) // n}").astype(np.int64)))
            if sum(len(k) for k, _ in held) > 2 * COMBINE:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
    if held:
        yield whole()


@dataclass
class SortedKeys:
    """The sorted keys of a folder: ``sizes`` has the number of keys of each of the ``2 ** bits`` shards."""

    folder: str
    bits: int
    sizes: np.ndarray
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted keys: shard, the slice of the keys in it, their places there, and which of them are there."""
        bounds = np.searchsorted(shard_of(keys, self.bits), np.arange((1 << self.bits) + 1))
        for shard in np.flatnonzero(np.diff(bounds)):
            part = slice(int(bounds[shard]), int(bounds[shard + 1]))
            if not self.sizes[shard]:
                yield int(shard), part, np.zeros(part.stop - part.start, np.int64), np.zeros(part.stop - part.start, bool)
                continue
            there = read_array(self.folder, f"{shard}.key", "<u8")
            at = np.minimum(np.searchsorted(there, keys[part]), len(there) - 1)
            yield int(shard), part, at, there[at] == keys[part]


#: Up to so many runs of a shard are searched one by one, more all at once.
RUNS = 32


def _not_below(values: np.ndarray, top: np.ndarray, run: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place in a sorted run of ``values`` whose value is not below the wanted one, else the end of the run; ``top`` has the starts of the runs."""
    if len(top) - 1 <= RUNS:
        cuts = np.searchsorted(run, np.arange(len(top)))
        found = [np.searchsorted(values[top[k] : top[k + 1]], wanted[cuts[k] : cuts[k + 1]]) + top[k] for k in np.flatnonzero(np.diff(cuts))]
        return np.concatenate(found)
    at, end = top[run], top[run + 1]
    for power in reversed(range(int(np.diff(top).max()).bit_length())):
        on = at + (1 << power)
        less = values[np.minimum(on, end) - 1] < wanted
        less &= on <= end
        at = at + (less.astype(np.int64) << power)
    return at


@dataclass
class NarrowKeys:
    """Sorted keys of ``width`` bits, like ``SortedKeys``; a shard stores the lower 32 bits of each key and where the run of each value of the bits between starts."""

    folder: str
    bits: int
    width: int
    sizes: np.ndarray
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    @staticmethod
    def write(folder: str, shard: int, bits: int, width: int, keys: np.ndarray) -> None:
        """The files of a shard."""
        rest = keys - shard_start(shard, bits, width)
        write_array(folder, f"{shard}.low", rest.astype("<u4"))
        runs = np.arange((1 << max(0, width - bits - 32)) + 1, dtype=np.uint64)
        write_array(folder, f"{shard}.top", np.searchsorted(rest >> np.uint64(32), runs).astype("<i8"))

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted keys: shard, the slice of the keys in it, their places there, and which of them are there."""
        bounds = np.searchsorted(shard_of(keys, self.bits, self.width), np.arange((1 << self.bits) + 1))
        for shard in np.flatnonzero(np.diff(bounds) * self.sizes):
            part = slice(int(bounds[shard]), int(bounds[shard + 1]))
            low, top = read_array(self.folder, f"{shard}.low", "<u4"), read_array(self.folder, f"{shard}.top", "<i8")
            rest = keys[part] - shard_start(shard, self.bits, self.width)
            run, wanted = (rest >> np.uint64(32)).astype(np.int64), rest.astype("<u4")
            at = _not_below(low, top, run, wanted)
            there = at < top[run + 1]
            at = np.minimum(at, len(low) - 1)
            yield int(shard), part, at, there & (low[at] == wanted)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys among all, -1 where they are not there."""
        out = np.full(len(keys), -1, np.int64)
        for shard, part, at, there in self.parts(keys):
            out[part] = np.where(there, at + self.starts[shard], -1)
        return out

    def cut(self, places: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """For sorted places among all: shard, the slice of the places in it, and the places there."""
        bounds = np.searchsorted(places, self.starts)
        for shard in np.flatnonzero(np.diff(bounds)):
            part = slice(int(bounds[shard]), int(bounds[shard + 1]))
            yield int(shard), part, places[part] - self.starts[shard]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The keys at sorted places."""
        out = np.zeros(len(places), np.uint64)
        for shard, part, at in self.cut(places):
            top = read_array(self.folder, f"{shard}.top", "<i8")
            run = (np.searchsorted(top, at, side="right") - 1).astype(np.uint64)
            low = read_array(self.folder, f"{shard}.low", "<u4")[at].astype(np.uint64)
            out[part] = (run << np.uint64(32) | low) + shard_start(shard, self.bits, self.width)
        return out


#: Counts from here on are kept apart from those of four bits.
MANY = 15


def write_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts of 0 or more, two in a byte; large ones in a second file with their places."""
    few = np.minimum(np.append(counts, np.zeros(len(counts) % 2, np.int64)), MANY).astype(np.uint8).reshape(-1, 2)
    write_array(folder, name, few[:, 0] | few[:, 1] << 4)
    many = np.flatnonzero(counts >= MANY)
    write_array(folder, f"{name}-many", np.concatenate([many, counts[many]]).astype("<i8"))


def read_counts(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """The counts at places of the file."""
    counts = (read_array(folder, name, "<u1")[at >> 1] >> (at & 1) * 4 & MANY).astype(np.int64)
    full = np.flatnonzero(counts == MANY)
    if len(full):
        places, values = read_array(folder, f"{name}-many", "<i8").reshape(2, -1)
        counts[full] = values[np.searchsorted(places, at[full])]
    return counts


#: Rows of three counts below this one are kept in a byte.
SIDE = 6


def write_classes(folder: str, name: str, numbers: np.ndarray) -> None:
    """Rows of three counts, a byte a row; rows with large ones in a second file with their places."""
    small = (numbers < SIDE).all(axis=1)
    write_array(folder, name, np.where(small, numbers @ np.array([1, SIDE, SIDE * SIDE]), 255).astype("<u1"))
    large = np.flatnonzero(~small)
    write_array(folder, f"{name}-many", np.concatenate([large, numbers[large].ravel()]).astype("<i8"))


def read_classes(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """The rows at places of the file."""
    codes = read_array(folder, name, "<u1")[at].astype(np.int64)
    numbers = np.stack([codes % SIDE, codes // SIDE % SIDE, codes // (SIDE * SIDE)], axis=1)
    full = np.flatnonzero(codes == 255)
    if len(full):
        stored = read_array(folder, f"{name}-many", "<i8")
        places, values = stored[: len(stored) // 4], stored[len(stored) // 4 :].reshape(-1, 3)
        numbers[full] = values[np.searchsorted(places, at[full])]
    return numbers

"""An adaptive radix tree over byte keys, with path compression.

Inner nodes change their layout as they fill: sorted bytes for up to 4 and up
to 16 children, a 256-byte index into up to 48, then a slot for every byte. A
node keeps the bytes that all keys below it share, so a long run without a
branch is one node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

SORTED_SIZES, INDEXED_SIZE, NONE = (4, 16), 48, 255


class Node:
    """``prefix`` leads from the parent's branch byte to here; ``end`` is the key that ends here or -1; ``low`` to ``high`` are the keys below."""

    __slots__ = ("prefix", "end", "low", "high", "size", "index", "kids")

    def __init__(self, prefix: bytes, key: int, end: int = -1) -> None:
        self.prefix, self.end, self.low, self.high = prefix, end, key, key
        self.size, self.index, self.kids = SORTED_SIZES[0], bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.size == 256:
            return self.kids[byte]
        if self.size == INDEXED_SIZE:
            at = self.index[byte]
            return None if at == NONE else self.kids[at]
        at = bisect_left(self.index, byte)
        return self.kids[at] if at < len(self.index) and self.index[at] == byte else None

    def put(self, byte: int, node: Node) -> None:
        """Adds a child, or replaces the one at ``byte``."""
        if self.size == 256:
            self.kids[byte] = node
        elif self.size == INDEXED_SIZE:
            if self.index[byte] != NONE:
                self.kids[self.index[byte]] = node
            elif len(self.kids) < INDEXED_SIZE:
                self.index[byte] = len(self.kids)
                self.kids.append(node)
            else:
                self._grow()
                self.kids[byte] = node
        else:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.kids[at] = node
            elif len(self.kids) < self.size:
                self.index.insert(at, byte)
                self.kids.insert(at, node)
            else:
                self._grow()
                self.put(byte, node)

    def _grow(self) -> None:
        if self.size == SORTED_SIZES[0]:
            self.size = SORTED_SIZES[1]
        elif self.size == SORTED_SIZES[1]:
            index = bytearray([NONE]) * 256
            for at, byte in enumerate(self.index):
                index[byte] = at
            self.size, self.index = INDEXED_SIZE, index
        else:
            kids: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.index):
                if at != NONE:
                    kids[byte] = self.kids[at]
            self.size, self.index, self.kids = 256, bytearray(), kids

    def children(self) -> Iterator[tuple[int, Node]]:
        """Branch byte and child, in order."""
        if self.size == 256:
            yield from ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)
        elif self.size == INDEXED_SIZE:
            yield from ((byte, self.kids[at]) for byte, at in enumerate(self.index) if at != NONE)
        else:
            yield from zip(self.index, self.kids, strict=True)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def insert(root: Node | None, key: bytes, number: int) -> Node:
    """The tree with ``key``, whose number must be above those of the keys before it."""
    if root is None:
        return Node(key, number, number)
    above, branch, node, depth = None, 0, root, 0
    while True:
        rest = key[depth:]
        same = _common(node.prefix, rest)
        if same < len(node.prefix):
            parent = Node(node.prefix[:same], node.low)
            parent.high = number
            parent.put(node.prefix[same], node)
            node.prefix = node.prefix[same + 1 :]
            if same == len(rest):
                parent.end = number
            else:
                parent.put(rest[same], Node(rest[same + 1 :], number, number))
            if above is None:
                return parent
            above.put(branch, parent)
            return root
        node.high = number
        depth += same
        if depth == len(key):
            node.end = number
            return root
        kid = node.child(key[depth])
        if kid is None:
            node.put(key[depth], Node(key[depth + 1 :], number, number))
            return root
        above, branch, node, depth = node, key[depth], kid, depth + 1

"""An adaptive radix tree over byte strings, for the keys of one task: node layouts grow with their children, single paths are compressed."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

SMALL, MIDDLE, LARGE = 4, 16, 48


class Node:
    """prefix: bytes that all keys below share, after the byte that leads here. value: of the key that ends here, if one does.

    Up to 16 children stand beside their sorted bytes (room for 4, then 16), up to 48 behind a table of 256 places, more in a table of 256.
    """

    __slots__ = ("prefix", "value", "layout", "bytes", "children")

    def __init__(self, prefix: bytes, value: object = None):
        self.prefix, self.value, self.layout, self.bytes, self.children = prefix, value, SMALL, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.children[byte]
        if self.layout == LARGE:
            slot = self.bytes[byte]
            return self.children[slot - 1] if slot else None
        at = self.bytes.find(byte)
        return self.children[at] if at >= 0 else None

    def add(self, byte: int, child: Node) -> None:
        """A child for a byte that has none yet; a full layout is exchanged for the next one."""
        if self.layout == 256:
            self.children[byte] = child
            return
        if len(self.children) == self.layout:
            self._grow()
            self.add(byte, child)
        elif self.layout == LARGE:
            self.children.append(child)
            self.bytes[byte] = len(self.children)
        else:
            at = bisect.bisect_left(self.bytes, byte)
            self.bytes.insert(at, byte)
            self.children.insert(at, child)

    def _grow(self) -> None:
        if self.layout == SMALL:
            self.layout = MIDDLE
        elif self.layout == MIDDLE:
            table = bytearray(256)
            for slot, byte in enumerate(self.bytes, 1):
                table[byte] = slot
            self.layout, self.bytes = LARGE, table
        else:
            self.layout, self.children, self.bytes = 256, [self.children[s - 1] if s else None for s in self.bytes], bytearray()

    def items(self) -> Iterator[Node]:
        """Children by their byte."""
        if self.layout == 256:
            return (c for c in self.children if c is not None)
        if self.layout == LARGE:
            return (self.children[s - 1] for s in self.bytes if s)
        return iter(self.children)

    def split(self, at: int) -> None:
        """Turn this node into one that ends after `at` bytes of its prefix, with what it was as the only child."""
        below = Node(self.prefix[at + 1 :], self.value)
        below.layout, below.bytes, below.children = self.layout, self.bytes, self.children
        byte = self.prefix[at]
        self.prefix, self.value, self.layout, self.bytes, self.children = self.prefix[:at], None, SMALL, bytearray((byte,)), [below]


def shared(a: bytes, b: bytes) -> int:
    """How many bytes a and b share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: object) -> None:
        """value replaces what the key had."""
        node, at = self.root, 0
        while True:
            same = shared(node.prefix, key[at : at + len(node.prefix)])
            if same < len(node.prefix):
                node.split(same)
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                node.add(key[at], Node(key[at + 1 :], value))
                return
            node, at = child, at + 1

    def walk(self, width: int) -> Iterator[tuple[int, int, object]]:
        """(depth, parent's number, value or None) of every prefix of a key whose length is a multiple of width, before what extends it, in the order of keys.

        Numbers count what came before; the empty prefix is 0, its parent -1. Keys' lengths are multiples of width.
        """
        yield 0, -1, self.root.value if not self.root.prefix else None
        made, todo = 1, [(self.root, 0, 0)]  # node, length of its parent's keys, number of the last prefix above
        while todo:
            node, begin, above = todo.pop()
            end = begin + len(node.prefix) + (node is not self.root)
            for depth in range(begin // width + 1, end // width + 1):
                yield depth, above, node.value if depth * width == end else None
                above, made = made, made + 1
            todo += [(child, end, above) for child in reversed(list(node.items()))]

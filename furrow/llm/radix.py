"""An adaptive radix tree over byte keys: nodes that grow with their children, whole edges as one label."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Sorted:
    """Up to `room` children: sorted first bytes beside the children."""

    __slots__ = ("label", "ends", "first", "below")
    room = 4

    def __init__(self, label: bytes, ends: list | None = None):
        self.label, self.ends, self.first, self.below = label, ends, bytearray(), []

    def get(self, byte: int):
        i = bisect_left(self.first, byte)
        return self.below[i] if i < len(self.first) and self.first[i] == byte else None

    def put(self, child) -> bool:
        """Add or replace the child with this first byte; False where there is no room."""
        byte = child.label[0]
        i = bisect_left(self.first, byte)
        if i < len(self.first) and self.first[i] == byte:
            self.below[i] = child
            return True
        if len(self.first) == self.room:
            return False
        self.first.insert(i, byte)
        self.below.insert(i, child)
        return True

    def children(self) -> Iterator:
        return iter(self.below)


class Node4(Sorted):
    __slots__ = ()


class Node16(Sorted):
    __slots__ = ()
    room = 16


class Node48:
    """Up to 48 children: 256 one-byte places into a short list."""

    __slots__ = ("label", "ends", "place", "below")
    room = 48

    def __init__(self, label: bytes, ends: list | None = None):
        self.label, self.ends, self.place, self.below = label, ends, bytearray(256), []

    def get(self, byte: int):
        return self.below[self.place[byte] - 1] if self.place[byte] else None

    def put(self, child) -> bool:
        byte = child.label[0]
        if self.place[byte]:
            self.below[self.place[byte] - 1] = child
            return True
        if len(self.below) == self.room:
            return False
        self.below.append(child)
        self.place[byte] = len(self.below)
        return True

    def children(self) -> Iterator:
        return (self.below[at - 1] for at in self.place if at)


class Node256:
    __slots__ = ("label", "ends", "below")

    def __init__(self, label: bytes, ends: list | None = None):
        self.label, self.ends, self.below = label, ends, [None] * 256

    def get(self, byte: int):
        return self.below[byte]

    def put(self, child) -> bool:
        self.below[child.label[0]] = child
        return True

    def children(self) -> Iterator:
        return (child for child in self.below if child is not None)


LARGER = {Node4: Node16, Node16: Node48, Node48: Node256}


class Tree:
    """Keys with the values that end at each; a key may be the prefix of another."""

    def __init__(self):
        self.root = Node4(b"")

    def insert(self, key: bytes, value) -> None:
        above, node, at = None, self.root, 0
        while True:
            rest = key[at : at + len(node.label)]
            same = len(rest) if node.label.startswith(rest) else shared(node.label, rest)
            if same < len(node.label):  # the key leaves inside the edge, or ends there
                upper = Node4(node.label[:same])
                node.label = node.label[same:]
                upper.put(node)
                above.put(upper)
                node = upper
            at += same
            if at == len(key):
                if node.ends is None:
                    node.ends = []
                node.ends.append(value)
                return
            child = node.get(key[at])
            if child is None:
                self._add(above, node, Node4(key[at:], [value]))
                return
            above, node = node, child

    def _add(self, above, node, leaf) -> None:
        if node.put(leaf):
            return
        grown = LARGER[type(node)](node.label, node.ends)
        for child in node.children():
            grown.put(child)
        grown.put(leaf)
        if above is None:
            self.root = grown
        else:
            above.put(grown)

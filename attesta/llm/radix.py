"""An adaptive radix tree over byte strings.

Inner nodes grow through four layouts: up to 4 and up to 16 children as sorted
key bytes beside their children, up to 48 through a 256-byte index, and one slot
per byte.  Chains without a branch are one node whose ``prefix`` holds the bytes
in between.
"""

from __future__ import annotations

from bisect import bisect_left


class Node:
    """One node: bytes below its branch byte, an optional value, children by next byte."""

    __slots__ = ("prefix", "value", "kind", "keys", "kids", "note")

    def __init__(self, prefix: bytes = b"", value=None):
        self.prefix, self.value, self.note = prefix, value, None
        self.kind, self.keys, self.kids = 4, bytearray(), []

    def child(self, byte: int):
        if self.kind <= 16:
            at = bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.kind == 48:
            return self.kids[self.keys[byte] - 1] if self.keys[byte] else None
        return self.kids[byte]

    def add(self, byte: int, node: Node) -> None:
        """A child under a byte that has none; a full layout grows to the next."""
        if self.kind <= 16 and len(self.kids) == self.kind:
            if self.kind == 4:
                self.kind = 16
            else:
                index = bytearray(256)
                for slot, key in enumerate(self.keys):
                    index[key] = slot + 1
                self.kind, self.keys = 48, index
        elif self.kind == 48 and len(self.kids) == 48:
            slots = [None] * 256
            for key in range(256):
                if self.keys[key]:
                    slots[key] = self.kids[self.keys[key] - 1]
            self.kind, self.keys, self.kids = 256, None, slots
        if self.kind <= 16:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, node)
        elif self.kind == 48:
            self.kids.append(node)
            self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def children(self):
        """(byte, child) in byte order."""
        if self.kind <= 16:
            return zip(self.keys, self.kids)
        if self.kind == 48:
            return ((b, self.kids[self.keys[b] - 1]) for b in range(256) if self.keys[b])
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)

    def split(self, length: int) -> None:
        """Keep ``length`` bytes of the prefix; the rest moves into a child."""
        below = Node(self.prefix[length + 1:], self.value)
        below.kind, below.keys, below.kids = self.kind, self.keys, self.kids
        byte = self.prefix[length]
        self.prefix, self.value = self.prefix[:length], None
        self.kind, self.keys, self.kids = 4, bytearray(), []
        self.add(byte, below)


def insert(root: Node, key: bytes, value) -> None:
    """Set the value of a key."""
    node, at = root, 0
    while True:
        prefix = node.prefix
        if not key.startswith(prefix, at):
            rest = key[at:at + len(prefix)]
            node.split(next((i for i, (x, y) in enumerate(zip(prefix, rest)) if x != y), len(rest)))
            prefix = node.prefix
        at += len(prefix)
        if at == len(key):
            node.value = value
            return
        below = node.child(key[at])
        if below is None:
            node.add(key[at], Node(key[at + 1:], value))
            return
        node, at = below, at + 1


def walk(root: Node, key: bytes):
    """The nodes on the way to a key that is in the tree."""
    node, at = root, 0
    while node is not None:
        yield node
        at += len(node.prefix)
        if at >= len(key):
            return
        node, at = node.child(key[at]), at + 1


def preorder(root: Node):
    """(node, depth in bytes above its branch byte, parent): parents before children, in key order."""
    stack = [(root, 0, None)]
    while stack:
        node, depth, parent = stack.pop()
        yield node, depth, parent
        end = depth + (parent is not None) + len(node.prefix)
        stack.extend((kid, end, node) for _, kid in reversed(list(node.children())))

"""Adaptive radix tree over byte keys of fixed-width parts.

Inner nodes grow with their children: up to 4 and up to 16 children lie beside their sorted bytes, up to 48 behind a
table of 256 places, and beyond that there is a slot for each byte.  Bytes without a branch are one node's prefix.
"""

from __future__ import annotations

from bisect import bisect_left


class Beside:
    """Children beside their sorted bytes, with room for 4 or 16."""

    def __init__(self, room: int, pairs: list | None = None) -> None:
        self.room, self.bytes, self.kids = room, bytearray(b for b, _ in pairs or ()), [kid for _, kid in pairs or ()]

    def find(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.kids[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def full(self) -> bool:
        return len(self.kids) == self.room

    def put(self, byte: int, kid) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
        else:
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)

    def pairs(self) -> list:
        return list(zip(self.bytes, self.kids, strict=True))


class Indexed:
    """Up to 48 children, found through a table from byte to place."""

    room = 48

    def __init__(self, pairs: list) -> None:
        self.places, self.kids = bytearray(256), []
        for byte, kid in pairs:
            self.put(byte, kid)

    def find(self, byte: int):
        return self.kids[self.places[byte] - 1] if self.places[byte] else None

    def full(self) -> bool:
        return len(self.kids) == self.room

    def put(self, byte: int, kid) -> None:
        if self.places[byte]:
            self.kids[self.places[byte] - 1] = kid
        else:
            self.kids.append(kid)
            self.places[byte] = len(self.kids)

    def pairs(self) -> list:
        return [(b, self.kids[p - 1]) for b, p in enumerate(self.places) if p]


class Direct:
    """A slot for each byte."""

    room = 256

    def __init__(self, pairs: list) -> None:
        self.kids = [None] * 256
        for byte, kid in pairs:
            self.kids[byte] = kid

    def find(self, byte: int):
        return self.kids[byte]

    def full(self) -> bool:
        return False

    def put(self, byte: int, kid) -> None:
        self.kids[byte] = kid

    def pairs(self) -> list:
        return [(b, kid) for b, kid in enumerate(self.kids) if kid is not None]


def grown(layout):
    """The next larger layout with the same children."""
    return Beside(16, layout.pairs()) if layout.room == 4 else Indexed(layout.pairs()) if layout.room == 16 else Direct(layout.pairs())


class Node:
    """``prefix`` follows the byte that leads here; ``value`` is that of the key that ends here."""

    __slots__ = ("layout", "prefix", "value")

    def __init__(self, prefix: bytes, value=None) -> None:
        self.prefix, self.value, self.layout = prefix, value, Beside(4)

    def put(self, byte: int, kid: Node) -> None:
        if self.layout.full() and self.layout.find(byte) is None:
            self.layout = grown(self.layout)
        self.layout.put(byte, kid)


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` agree with ``b`` from ``at`` on."""
    if b.startswith(a, at):
        return len(a)
    low, high = 0, min(len(a), len(b) - at)
    while low < high:  # the longest agreeing start, by halves
        middle = (low + high + 1) // 2
        if a[:middle] == b[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Tree:
    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        """Keys are put in once each; a key may be the beginning of another."""
        if self.root is None:
            self.root = Node(key, value)
            return
        parent, led, node, at = None, 0, self.root, 0
        while True:
            same = common(node.prefix, key, at)
            if same < len(node.prefix):
                upper = Node(node.prefix[:same])
                led_on, node.prefix = node.prefix[same], node.prefix[same + 1 :]
                upper.put(led_on, node)
                if parent is None:
                    self.root = upper
                else:
                    parent.put(led, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            kid = node.layout.find(key[at])
            if kid is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            parent, led, node, at = node, key[at], kid, at + 1

    def walk(self) -> list[tuple[Node, int, int]]:
        """Every node after its parent, with the parent's place in the list (-1 for the root) and the depth in bytes at its end."""
        out, todo = [], [(self.root, -1, 0)] if self.root else []
        while todo:
            node, above, start = todo.pop()
            end = start + len(node.prefix)
            out.append((node, above, end))
            at = len(out) - 1
            todo += [(kid, at, end + 1) for _, kid in reversed(node.layout.pairs())]
        return out

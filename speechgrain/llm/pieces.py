"""What the tokenising operators share: bounded caches of encoded pieces, and cutting of very long texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence


class Cache(dict):
    """A bounded memo in two generations: when the young one is full it becomes the old one, and the old one is dropped.

    ``size`` bounds the bytes of a generation: those of keys and values, and ``ENTRY`` more for each. A piece that is too long
    for any generation is encoded and not kept. Looking pieces up is one pass in C; only missing ones come to Python.
    """

    ENTRY = 150

    def __init__(self, encode: Callable[[str], bytes], size: int = 32 << 20):
        super().__init__()
        self.encode, self.size, self.held = encode, size, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.encode(piece)
        cost = len(piece) + len(value) + self.ENTRY
        if cost <= self.size:
            if self.held + cost > self.size:
                self.old, self.held = self.copy(), 0
                self.clear()
            self[piece] = value
            self.held += cost
        return value

    def join(self, parts: list[str]) -> bytes:
        """The encodings of ``parts``, joined."""
        return b"".join(map(self.__getitem__, parts))


class BatchCache:
    """The same memo for an encoder of many pieces at once: what is missing is encoded together."""

    ENTRY = Cache.ENTRY

    def __init__(self, encode: Callable[[Sequence[bytes]], Sequence[bytes]], size: int = 32 << 20):
        self.encode, self.size, self.held = encode, size, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def many(self, parts: list[bytes]) -> list[bytes]:
        """The encoding of each of ``parts``, which are distinct."""
        out = list(map(self.young.get, parts))
        missing = [i for i, x in enumerate(out) if x is None]
        now = {parts[i]: x for i in missing if (x := self.old.get(parts[i])) is not None}
        new = [parts[i] for i in missing if parts[i] not in now]
        now.update(zip(new, self.encode(new), strict=True))
        for i in missing:
            out[i] = now[parts[i]]
        cost = sum(map(len, now)) + sum(map(len, now.values())) + self.ENTRY * len(now)
        if self.held + cost > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        if cost <= self.size:
            self.young.update(now)
            self.held += cost
        return out


def cut_before(text: str, is_cut: Callable[[str, int], bool], size: int = 1 << 20) -> Iterator[str]:
    """``text`` in pieces of about ``size``, each later one beginning where ``is_cut(text, i)`` holds; whole if it never does."""
    begin = 0
    while len(text) - begin > size:
        at = begin + size
        while at < len(text) and not is_cut(text, at):
            at += 1
        yield text[begin:at]
        begin = at
    yield text[begin:] if begin else text

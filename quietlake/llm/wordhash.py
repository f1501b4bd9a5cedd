"""Words of many texts at once: their places and 64-bit hashes, in numpy.

A word's hash takes in eight bytes at a time, each step a multiplication and shifts that no
structure of the word cancels; words over ``LONG`` bytes are hashed by BLAKE2b. Words of up to eight
bytes and of one length never share a hash. Whoever needs to be sure compares bytes: :class:`Store`.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer words are hashed and compared one by one.
LONG = 64
#: The first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def spaces_table(spaces: bytes, lower: bool = True) -> bytes:
    """For bytes.translate: the given bytes become a space, A-Z a-z."""
    return bytes(32 if i in spaces else i + 32 if lower and 65 <= i <= 90 else i for i in range(256))


#: Words are what \x20 and \x09-\x0D separate, A-Z lower-cased.
BLANKS = spaces_table(b" \t\n\x0b\x0c\r")


def _eights(buf: bytes | bytearray | np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on, whose last eight are spare, as numbers."""
    return np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))


class Words:
    """Words of texts: ``buf`` holds all, word i is ``buf[starts[i]:ends[i]]``, text j has ``counts[j]`` words."""

    def __init__(self, texts: list[bytes], table: bytes = BLANKS) -> None:
        self.buf = (b" " + b" ".join(texts) + b" " * 9).translate(table)
        blank = np.frombuffer(self.buf, np.uint8) == 32
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        bounds = np.cumsum([1, *(len(x) + 1 for x in texts)])
        at = np.searchsorted(self.starts, bounds)
        self.counts = at[1:] - at[:-1]
        self.sizes = self.ends - self.starts
        self.eights = _eights(self.buf)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        h = mix((self.sizes.astype(np.uint64) * _SIZE) ^ (self.eights[self.starts] & _FIRST[np.minimum(self.sizes, 8)]))
        left = np.flatnonzero((self.sizes > 8) & (self.sizes <= LONG))
        k = 8
        while len(left):
            x = self.eights[self.starts[left] + k] & _FIRST[np.minimum(self.sizes[left] - k, 8)]
            h[left] = mix((h[left] * _STEP) ^ x)
            k += 8
            left = left[self.sizes[left] > k]
        for i in np.flatnonzero(self.sizes > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return h

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]]


class Store:
    """Bytes of words, by place; compares whole arrays of words with them."""

    def __init__(self) -> None:
        self.buf = bytearray(1 << 12)
        self.used = 0
        self.offsets, self.sizes = np.zeros(1 << 8, np.int64), np.zeros(1 << 8, np.int64)
        self.n = 0

    def add(self, words: list[bytes]) -> None:
        """Add words; they get the next places."""
        sizes = np.array([len(x) for x in words], np.int64)
        n, used = self.n + len(words), self.used + int(sizes.sum())
        if used + 8 > len(self.buf):
            self.buf = self.buf[: self.used] + bytes(max(used + 8, 2 * len(self.buf)) - self.used)
        if n > len(self.sizes):
            more = np.zeros(max(n, 2 * len(self.sizes)) - len(self.sizes), np.int64)
            self.offsets, self.sizes = np.concatenate([self.offsets, more]), np.concatenate([self.sizes, more])
        self.buf[self.used : used] = b"".join(words)
        self.sizes[self.n : n] = sizes
        self.offsets[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def word(self, i: int) -> bytes:
        return bytes(self.buf[self.offsets[i] : self.offsets[i] + self.sizes[i]])

    def same(self, words: Words, places: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Whether each of the words (those at ``which``, or all) is the one at its place; False at places under 0."""
        starts, sizes = (words.starts, words.sizes) if which is None else (words.starts[which], words.sizes[which])
        out = places >= 0
        out[out] = self.sizes[places[out]] == sizes[out]
        mine, k = _eights(self.buf), 0
        left = np.flatnonzero(out & (sizes <= LONG))
        while len(left):
            first = _FIRST[np.minimum(sizes[left] - k, 8)]
            out[left] = (words.eights[starts[left] + k] & first) == (mine[self.offsets[places[left]] + k] & first)
            k += 8
            left = left[out[left] & (sizes[left] > k)]
        for i in np.flatnonzero(out & (sizes > LONG)).tolist():
            out[i] = words.buf[starts[i] : starts[i] + sizes[i]] == self.word(places[i])
        return out


class Table:
    """Places of 64-bit keys, by open addressing; finds and adds whole arrays."""

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.n = 0
        self.keys = np.zeros(1 << 10, np.uint64)
        self._resize(12)
        if keys is not None:
            self.add(np.asarray(keys, np.uint64))

    @classmethod
    def of(cls, keys: np.ndarray, slots: np.ndarray) -> Table:
        """A table of arrays that another had; nothing can be added to it."""
        out = cls.__new__(cls)
        out.n, out.keys, out.slots, out.bits = len(keys), keys, slots, len(slots).bit_length() - 1
        return out

    def _resize(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)
        self._insert(np.arange(self.n))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, left: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = self._hash(self.keys[left])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & mask

    def add(self, keys: np.ndarray) -> None:
        """Add keys that are new and all different; they get the next places."""
        n = self.n + len(keys)
        if n > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.n], np.zeros(max(n, 2 * len(self.keys)) - self.n, np.uint64)])
        self.keys[self.n : n] = keys
        first, self.n = self.n, n
        if 3 * n > 1 << self.bits:
            self._resize(int(np.ceil(np.log2(4 * n))))
        else:
            self._insert(np.arange(first, n))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        mask = (1 << self.bits) - 1
        at = self._hash(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        return out


class Vocabulary:
    """Different words, by place: found by hash, told apart by their bytes.

    A word whose bytes aren't those kept under its hash is sought under the hash's hash.
    """

    def __init__(self) -> None:
        self.table, self.store = Table(), Store()

    @property
    def n(self) -> int:
        return self.store.n

    def find(self, words: Words) -> np.ndarray:
        """Each word's place, or -1."""
        return self._places(words, None)

    def grow(self, words: Words) -> tuple[np.ndarray, list[bytes]]:
        """Each word's place, and the words that were new, which have the last places."""
        new: list[bytes] = []
        return self._places(words, new), new

    def _places(self, words: Words, new: list[bytes] | None) -> np.ndarray:
        at = np.full(len(words.hashes), -1, np.int64)
        left, keys = np.arange(len(at)), words.hashes
        while len(left):
            found = self.table.find(keys).astype(np.int64)
            miss = found < 0
            if new is None:
                left, keys, found = left[~miss], keys[~miss], found[~miss]
            elif miss.any():
                fresh, first, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
                names = [words.word(i) for i in left[miss][first].tolist()]
                found[miss] = self.table.n + inverse
                self.table.add(fresh)
                self.store.add(names)
                new += names
            ok = self.store.same(words, found, left)
            at[left[ok]] = found[ok]
            left, keys = left[~ok], mix(keys[~ok] + np.uint64(1))
        return at

    def arrays(self) -> dict[str, np.ndarray]:
        """All of it as arrays; :meth:`of` takes them back, from memory or from a mapped file."""
        t, s = self.table, self.store
        return {"keys": t.keys[: t.n], "slots": t.slots, "letters": np.frombuffer(bytes(s.buf[: s.used]) + bytes(8), np.uint8), "offsets": s.offsets[: s.n], "sizes": s.sizes[: s.n]}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Vocabulary:
        out = cls()
        out.table = Table.of(arrays["keys"], arrays["slots"])
        out.store.buf, out.store.offsets, out.store.sizes = arrays["letters"], arrays["offsets"], arrays["sizes"]
        out.store.n, out.store.used = len(arrays["sizes"]), len(arrays["letters"]) - 8
        return out

"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A piece starts as its byte symbols, the last one with the word-end mark. The leaves of a segment tree hold, for each
symbol, the rank of the merge with its right neighbour (or infinity), so that the root is the lowest rank, and going down from
it to the left wherever the left child is as low leads to its leftmost place. A merge is a point update of three leaves, each in
logarithmic time; it ends when the root is infinite. Long pieces thus cost n log n, not n squared.

Every piece of two symbols or more goes through such a tree. RankTrees holds the trees of many pieces side by side in
numpy, one merge of each in a round, and its nodes hold a merge's place as well, which spares the way down; a piece of more
than WIDE bytes has a tree of its own, as rounds for it alone would cost more than they save, whose nodes know no places, so that
it may have any number of leaves.

A text is first split at the special strings, then normalized (NFC, lower case letter by letter) and cut into pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import regex

NEVER = 1 << 62  # no merge; a merge is rank << 40 | merged id, between them, for at most WIDE leaves, the place << 20
LOW = (1 << 20) - 1
WIDE = 256  # bytes of a piece that is merged beside others
#: Fixed values of the tokenizer's own file: what its normalizer and splitter do.
SPACE = regex.compile(r"\s+")  # as the splitter's own class has it; str.split differs in the four separators only
SEPARATORS = re.compile("[\x1c-\x1f]")
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next free character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def lowered(text: str) -> str:
    """Lower case letter by letter, without the rule for a sigma that ends a word."""
    return text.replace("Σ", "σ").lower()


def width_for(leaves: int) -> int:
    """The least power of two that holds so many leaves."""
    return 1 << max(0, leaves - 1).bit_length()


class RankTree:
    """One piece's tree: node 1 is the root, node i's children are 2 i and 2 i + 1."""

    def __init__(self, merges: np.ndarray):
        self.width = width_for(len(merges))
        nodes = np.full(2 * self.width, NEVER)
        nodes[self.width : self.width + len(merges)] = merges
        low = self.width
        while low > 1:
            nodes[low // 2 : low] = nodes[low : 2 * low].reshape(-1, 2).min(1)
            low //= 2
        self.nodes = array("q", nodes.tobytes())

    def root(self) -> int:
        return self.nodes[1]

    def place(self) -> int:
        """The leftmost leaf that is as low as the root."""
        nodes, i, least = self.nodes, 1, self.nodes[1]
        while i < self.width:
            i *= 2
            if nodes[i] != least:
                i += 1
        return i - self.width

    def put(self, place: int, merge: int) -> None:
        nodes, i = self.nodes, self.width + place
        nodes[i] = merge
        while i > 1:
            least = min(nodes[i], nodes[i ^ 1])
            i >>= 1
            if nodes[i] == least:  # nothing above it changes
                return
            nodes[i] = least


class RankTrees:
    """The trees of many pieces, a row each, over merges of (pieces, leaves)."""

    def __init__(self, merges: np.ndarray):
        m, leaves = merges.shape
        self.width = width_for(leaves)
        self.nodes = np.full((m, 2 * self.width), NEVER)
        self.nodes[:, self.width : self.width + leaves] = merges
        low = self.width
        while low > 1:
            below = self.nodes[:, low : 2 * low]
            low //= 2
            np.minimum(below[:, ::2], below[:, 1::2], out=self.nodes[:, low : 2 * low])

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return self.nodes[rows, 1]

    def put(self, rows: np.ndarray, places: np.ndarray, merges: np.ndarray) -> None:
        """Set leaves, of one row several too, and what is above them. Places outside of the tree are passed over."""
        flat, base = self.nodes.reshape(-1), rows * (2 * self.width)
        at = np.where((places >= 0) & (places < self.width), places + self.width, 0)  # node 0 is nobody's
        flat[base + at] = merges
        for _ in range(self.width.bit_length() - 1):
            at >>= 1
            child = base + 2 * at
            flat[base + at] = np.minimum(flat[child], flat[child + 1])


class PairTable:
    """rank << 40 | merged id of pairs of ids, by a hash table of levels."""

    SIZE = 18

    def __init__(self, merge: dict[int, tuple[int, int]]):
        pairs = np.fromiter(merge, np.int64, len(merge))
        rank, new = np.array(list(merge.values()), np.int64).reshape(-1, 2).T
        self.levels = []
        while len(pairs):
            slot = self._slot(pairs, len(self.levels))
            first = np.unique(slot, return_index=True)[1]
            key, value = np.full(1 << self.SIZE, -1), np.full(1 << self.SIZE, NEVER)
            key[slot[first]], value[slot[first]] = pairs[first], rank[first] << 40 | new[first]
            self.levels.append((key, value))
            rest = np.ones(len(pairs), bool)
            rest[first] = False
            pairs, rank, new = pairs[rest], rank[rest], new[rest]

    def _slot(self, pairs: np.ndarray, level: int) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        return (mixed >> np.uint64(64 - self.SIZE)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NEVER where there is no merge; a negative id has none."""
        pairs = left << 32 | right
        out = np.full(pairs.shape, NEVER)
        for level, (key, value) in enumerate(self.levels):
            slot = self._slot(pairs, level)
            np.copyto(out, value[slot], where=key[slot] == pairs)
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merge = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + self.end] for s in symbols]
        self.pair, self.inner_ids, self.last_ids = PairTable(self.merge), np.array(self.inner), np.array(self.last)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece = regex.compile(PIECE)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one piece, by a tree of its own."""
        start = self.inner_ids[np.frombuffer(raw, np.uint8)]
        start[-1] = self.last[raw[-1]]
        n = len(start)
        tree = RankTree(self.pair(start[:-1], start[1:]))
        ids, right, left = (array("q", a.astype(np.int64).tobytes()) for a in (start, np.arange(1, n + 1), np.arange(-1, n - 1)))

        def merge(i: int, j: int) -> int:
            rank, new = self.merge.get(ids[i] << 32 | ids[j], (None, 0))
            return NEVER if rank is None else rank << 40 | new

        while n > 1 and (root := tree.root()) < NEVER:
            i = tree.place()
            j = right[i]
            ids[i], ids[j] = root & LOW, -1
            k = right[i] = right[j]
            if j < n - 1:
                tree.put(j, NEVER)
            if k < n:
                left[k] = i
            tree.put(i, merge(i, k) if k < n else NEVER)
            if (h := left[i]) >= 0:
                tree.put(h, merge(h, i))
        return [i for i in ids if i >= 0]

    def merged_together(self, raws: list[bytes]) -> list[bytes]:
        """The ids of many pieces, as little-endian unsigned 32-bit numbers, by trees side by side."""
        m, n = len(raws), max(map(len, raws))
        rows, size = np.arange(m), np.fromiter(map(len, raws), np.int64, m)
        raw = np.frombuffer(b"".join([r.ljust(n, b"\0") for r in raws]), np.uint8).reshape(m, n)
        ids = np.full((m, n + 1), -1)  # the last column stands for no neighbour
        ids[:, :n] = np.where(np.arange(n) < size[:, None], self.inner_ids[raw], -1)
        ids[rows, size - 1] = self.last_ids[raw[rows, size - 1]]
        if n > 1:
            places = np.arange(n - 1) << 20
            trees = RankTrees(self.pair(ids[:, : n - 1], ids[:, 1:n]) | places)
            right, left = np.tile(np.minimum(np.arange(1, n + 2), n), (m, 1)), np.tile(np.r_[n, np.arange(n)], (m, 1))
            while True:
                best = trees.roots(rows)
                live = best < NEVER
                rows, best = rows[live], best[live]
                if not len(rows):
                    break
                i, new = best >> 20 & LOW, best & LOW
                j, h = right[rows, i], left[rows, i]
                k = right[rows, j]
                ids[rows, i], ids[rows, j] = new, -1
                right[rows, i], left[rows, k] = k, i
                pair = self.pair(np.concatenate([new, ids[rows, h]]), np.concatenate([ids[rows, k], new]))
                at = np.concatenate([i, h])
                trees.put(np.concatenate([rows, rows, rows]), np.concatenate([j, at]), np.concatenate([np.full(len(rows), NEVER), pair | at << 20]))
        there = ids >= 0
        flat = ids[there].astype("<u4").tobytes()
        ends = (4 * np.cumsum(there.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def parts(self, text: str) -> list[str | int]:
        """The text between special strings, normalized, and the ids of these."""
        special = self.cut is not None and "<|" in text
        out: list[str | int] = []
        for part in self.cut.split(text) if special else (text,):
            if special and part in self.special:
                out.append(self.special[part])
            else:
                out.append(lowered(part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)))
        return out

    def encode(self, text: str | None) -> list[int]:
        """A text's ids, piece by piece. token_ids has the same for many texts at once."""
        out: list[int] = []
        for part in self.parts(text or ""):
            if isinstance(part, int):
                out.append(part)
            else:
                for p in self.piece.findall(part):
                    out += self.merged(p.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as the tokenizer, which has no decoder of its own, does."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF

"""Byte-pair merge tables read from a public tokenizer file, and the checks that several operators make on them."""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np

NONE = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Tokens, merges and splits of a BPE file whose merged ids follow the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max(*self.vocab.values(), *self.special.values()) + 1
        self.tokens = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.size = size
        self.left, self.right = np.arange(size), np.arange(size)
        self.pair: dict[tuple[int, int], int] = {}
        last = -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            joined = self.vocab[a + (b[: -len(self.suffix)] if self.suffix and b.endswith(self.suffix) else b) + (self.suffix if self.suffix and b.endswith(self.suffix) else "")]
            if joined <= last:
                raise ValueError("merged ids don't follow the order of the merges")
            last = joined
            x, y = self.vocab[a], self.vocab[b]
            self.pair[x, y] = joined
            self.left[joined], self.right[joined] = x, y
        keys = np.fromiter((x * size + y for x, y in self.pair), dtype=np.int64, count=len(self.pair))
        made = np.fromiter(self.pair.values(), dtype=np.int64, count=len(self.pair))
        order = np.argsort(keys)
        self._keys, self._made = keys[order], made[order]
        merged = np.flatnonzero(self.left != np.arange(size))
        #: Tokens that merging their own text gives back.
        self.sound = np.ones(size, dtype=bool)
        self.sound[merged] = self.parted(self.left[merged], self.right[merged], merged)
        for t in merged:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or NONE."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._made[at], NONE)

    def parted(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves each adjacent pair apart (until merge `before`, if given).

        Merging the text of a pair can only differ from the pair itself by a merge across the
        border. So the two tokens are taken apart again, the later made first, and at each step the
        pieces at the border must not have had a merge of their own while both were there.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NONE) if before is None else before.astype(np.int64)
        out, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            crossed = self.merged(a, b) < limit
            out[live[crossed]] = False
            a, b, limit, live = a[~crossed], b[~crossed], limit[~crossed], live[~crossed]
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            undo_a = ~whole_a & ((a > b) | whole_b)
            undo_b = ~whole_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            on = undo_a | undo_b
            a, b, limit, live = a[on], b[on], limit[on], live[on]
        return out

    def apart(self, a: int, b: int) -> bool:
        """`parted` for one pair."""
        limit, pair, left, right = int(NONE), self.pair, self._left, self._right
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            whole_a, whole_b = left[a] == a, left[b] == b
            if not whole_a and (a > b or whole_b):
                limit, a = a, right[a]
            elif not whole_b:
                limit, b = b + 1, left[b]
            else:
                return True

    @functools.cached_property
    def _left(self) -> list[int]:
        return self.left.tolist()

    @functools.cached_property
    def _right(self) -> list[int]:
        return self.right.tolist()

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: the earliest merge first, leftmost first among its places."""
        if len(symbols) > 200:
            return self._merge_long(symbols)
        get, none = self.pair.get, self.size
        ranks = [get(x, none) for x in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [best]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((best, symbols[i + 1]), none)
            if i:
                ranks[i - 1] = get((symbols[i - 1], best), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of places and links between neighbours, in n log n steps."""
        n, get = len(symbols), self.pair.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get((made, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, made, symbols[k]))
            if (h := before[i]) >= 0 and (r := get((symbols[h], made))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], made))
        return [s for s in symbols if s >= 0]


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def latin_classes() -> tuple[str, str]:
    """The letters and the numbers below U+0250 as regular-expression classes."""
    import unicodedata

    def ranges(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)

    return ranges("L"), ranges("N")

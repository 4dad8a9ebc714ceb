"""Byte-pair merges driven by a segment tree over the ranks of adjacent pairs.

Leaf ``i`` holds ``rank * leaves + i`` for the pair that starts at symbol ``i``
(or ``NONE``), inner nodes hold the minimum of their children, so the root is
the leftmost pair of the lowest rank.  A merge changes at most three leaves,
each of which is carried to the root in ``log2(leaves)`` steps.

Short words of one leaf count are merged together, one merge a word and round,
with numpy holding all their trees; longer words get a tree each.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int64(2**62)
#: Words of at most so many symbols share arrays.
SHARED_LEAVES = 64
_CHUNK = 2_048


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class MergeTable:
    """Symbols and merges of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (*vocab.items(), *self.special.items())}
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.span = max(vocab.values()) + 2
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.span + right
        # A pair listed twice keeps its last rank, as a mapping built in order does.
        _, at = np.unique(keys[::-1], return_index=True)
        order = len(keys) - 1 - at
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; negative symbols never merge."""
        keys = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty byte string."""
        out: list[list[int]] = [[]] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            leaves = 1 << (len(w) - 1).bit_length()
            if leaves <= SHARED_LEAVES:
                groups.setdefault(leaves, []).append(i)
            else:
                out[i] = self._merge_one(w)
        for leaves, members in groups.items():
            for s in range(0, len(members), _CHUNK):
                part = members[s:s + _CHUNK]
                ids, counts = self._merge_many([words[i] for i in part], leaves)
                flat, end = ids.tolist(), 0
                for i, n in zip(part, counts.tolist()):
                    out[i] = flat[end:end + n]
                    end += n
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each non-empty byte string, without making id lists."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        leaves = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for n in np.unique(leaves).tolist():
            members = np.flatnonzero(leaves == n)
            if n > SHARED_LEAVES:
                for i in members.tolist():
                    out[i] = len(self._merge_one(words[i]))
                continue
            for s in range(0, len(members), _CHUNK):
                part = members[s:s + _CHUNK]
                out[part] = self._merge_many([words[i] for i in part.tolist()], n)[1]
        return out

    def _merge_many(self, words: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), leaves + 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        live = np.arange(width) < sizes[:, None]
        sym = np.full((n, width), -1, np.int64)
        sym[live] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.fromiter((w[-1] for w in words), np.int64, n)
        sym[np.arange(n), sizes - 1] = self.last[ends]
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        at = np.arange(leaves)
        rank = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + at, NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2],
                                                   tree[:, level + 1:2 * level:2])
            level //= 2
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        sym_, live_, tree_ = sym.reshape(-1), live.reshape(-1), tree.reshape(-1)
        after_, before_ = after.reshape(-1), before.reshape(-1)
        act = np.flatnonzero(tree[:, 1] < NONE)
        while len(act):
            row, trow = act * width, act * (2 * leaves)
            root = tree_[trow + 1]
            pos = root % leaves
            new = self.made[root // leaves]
            gone = after_[row + pos]
            nxt = np.minimum(after_[row + gone], leaves)  # the last column is never live
            prv = before_[row + pos]
            sym_[row + pos] = new
            live_[row + gone] = False
            sym_[row + gone] = -1
            after_[row + pos] = nxt
            before_[row + nxt] = pos
            rank = self.rank(new, sym_[row + nxt])
            tree_[trow + leaves + pos] = np.where(rank < NONE, rank * leaves + pos, NONE)
            tree_[trow + leaves + gone] = NONE
            has = prv >= 0
            old = np.where(has, prv, pos)
            rank = np.where(has, self.rank(sym_[row + old], new), rank)
            tree_[trow + leaves + old] = np.where(rank < NONE, rank * leaves + old, NONE)
            nodes = [leaves + pos, leaves + gone, leaves + old]
            for _ in range(leaves.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    child = trow + 2 * x
                    tree_[trow + x] = np.minimum(tree_[child], tree_[child + 1])
            act = act[tree_[trow + 1] < NONE]
        return sym[live], live.sum(1)

    def _merge_one(self, word: bytes) -> list[int]:
        n = len(word)
        leaves = 1 << (n - 1).bit_length()
        none = int(NONE)
        sym = self.first[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        made, rank_of, span = self.made, self.rank_of, self.span

        def key(i: int, j: int) -> int:
            rank = rank_of.get(sym[i] * span + sym[j])
            return none if rank is None else rank * leaves + i

        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = key(i, i + 1)
        for x in range(leaves - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = leaves + i
            tree[x] = value
            while x > 1:
                x >>= 1
                low = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == low:
                    break
                tree[x] = low

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            rank, pos = divmod(tree[1], leaves)
            gone = after[pos]
            nxt, prv = after[gone], before[pos]
            sym[pos], sym[gone] = int(made[rank]), -1
            after[pos] = nxt
            if nxt < n:
                before[nxt] = pos
            put(gone, none)
            put(pos, key(pos, nxt) if nxt < n else none)
            if prv >= 0:
                put(prv, key(prv, pos))
        return [s for s in sym if s >= 0]

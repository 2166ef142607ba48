"""Byte-level BPE tables read from a public tokenizer file, and exact merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

#: Bytes that stand for themselves; the other bytes take code points from 256 on (fixed values of the format).
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Bits of a token id; ids are below 1 << _ID.
_ID = 20
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary."""
    others = iter(range(256, 512))
    return [chr(b) if b in _PRINTED else chr(next(others)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks; small (bounded by the vocabulary) and sent to workers once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a plain BPE model is needed")
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts: dict[int, str] = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.letters = byte_letters()
        # rank and result of a pair as one number, which compares faster than a tuple
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[left], self.vocab[right]] = rank << _ID | self.vocab[left + right]
        self.first = [self.vocab.get(x, -1) for x in self.letters]
        self.last = [self.vocab.get(x + self.suffix, -1) for x in self.letters]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: always the pair of lowest rank, leftmost first."""
        ids = [self.first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        if -1 in ids:  # letters outside the vocabulary vanish
            ids = [x for x in ids if x >= 0]
        return self._long(ids) if len(ids) > 96 else self._short(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, mask = self.pairs.get, (1 << _ID) - 1
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = best & mask
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        n, get, mask = len(ids), self.pairs.get, (1 << _ID) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1]), _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = best & mask, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := get((ids[k], ids[after[k]]), _NONE)) != _NONE:
                    heapq.heappush(heap, (p, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Cut out added tokens, leftmost and longest first: (plain text, added id that follows)."""
        begin = 0
        while True:
            hits = [(at, -len(t), t) for t in self.added if (at := text.find(t, begin)) >= 0]
            if not hits:
                yield text[begin:], None
                return
            at, _, token = min(hits)
            yield text[begin:at], self.added[token]
            begin = at + len(token)


class Memo(dict):
    """Bounded memory of what pieces of text become; ``make`` is exact, so emptying it loses nothing."""

    def __init__(self, make, most: int = 600_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value

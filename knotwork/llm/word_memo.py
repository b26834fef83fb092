"""Word-by-word memory in front of a tokenizer whose result is the concatenation over words."""

from __future__ import annotations

from collections.abc import Callable


#: Words given to the tokenizer in one call.
AT_ONCE = 10_000


class WordMemo:
    """Ids of texts whose tokenizer never joins anything across a word's edge.

    Text of any corpus repeats its words; so each distinct word is encoded once per process and texts
    are put together from what is remembered. ``encode_words`` maps a list of words (bytes) to a list of
    their ids (the bytes of an array); ``split`` maps a text's bytes to its words. The memory
    holds ``room`` words in each of two generations and forgets the older one when the younger is full,
    so it is bounded and keeps what is in use."""

    def __init__(self, encode_words: Callable, split: Callable[[bytes], list[bytes]], room: int):
        self.encode_words, self.split, self.room = encode_words, split, room
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        fresh = []
        for w in words:
            if (x := self.old.get(w)) is None:
                fresh.append(w)
            else:
                self.young[w] = x
        # what a tokenizer returns for a word is many times its size: only some at a time
        for i in range(0, len(fresh), AT_ONCE):
            some = fresh[i : i + AT_ONCE]
            for w, ids in zip(some, self.encode_words(some), strict=True):
                self.young[w] = ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as the bytes of an array."""
        if len(self.young) > self.room:
            self.young, self.old = {}, self.young
        get, out, open_, unknown = self.young.get, [], [], set()
        for i, t in enumerate(texts):
            words = self.split(t)
            parts = list(map(get, words))
            if None in parts:
                holes = [(j, words[j]) for j, x in enumerate(parts) if x is None]
                unknown.update([w for _, w in holes])
                open_.append((i, parts, holes))
                out.append(b"")
            else:
                out.append(b"".join(parts))
        self._learn(unknown)
        sure = self.young
        for i, parts, holes in open_:
            for j, w in holes:
                parts[j] = sure[w]
            out[i] = b"".join(parts)
        return out


def batches(texts, most_bytes: int = 4 << 20, size=len):
    """Slices of ``texts`` of about ``most_bytes``, so that very long texts come alone."""
    at = held = n = 0
    for t in texts:
        held, n = held + size(t), n + 1
        if held >= most_bytes:
            yield slice(at, n)
            at, held = n, 0
    if at < n:
        yield slice(at, n)

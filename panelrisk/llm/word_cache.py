"""Encoding texts word by word through a cache that lives in each Python worker.

The byte-level pattern never puts a non-space and a following space into one token.
A text whose white space is single spaces and line feeds between words is therefore the
sum of its space-led words, and each distinct word is encoded once per worker. Other
texts are encoded whole, so the result never depends on the cache.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words kept per worker, and the longest word kept.
CACHE_SIZE = 350_000
CACHED_CHARS = 64

#: White space other than space and line feed, and the mark used for splitting.
_ODD = re.compile("[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SIGNS = ".,;:!?#*$%&|<>"


def splits(text: str) -> bool:
    """Whether a text that is not empty is the sum of its words, or must be encoded whole."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text
                or "\n " in text or "\n\n" in text or _ODD.search(text))


def marked(texts):
    """Arrow texts with a mark between words: before a space, around a line feed."""
    return pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")


def _stem(word: str):
    """The letters before closing signs, which the pattern always cuts off as one; else None."""
    if word[-1] in _SIGNS:
        stem = word.rstrip(_SIGNS)
        if (stem[1:] if stem[:1] == " " else stem).isalpha():
            return stem
    return None


#: Bytes that an entry takes besides its characters and ids: two objects and their place.
ENTRY_BYTES = 200


def cost(words) -> int:
    """About the bytes that a dict of words and ids takes."""
    return ENTRY_BYTES * len(words) + 2 * sum(map(len, words)) + sum(map(len, words.values()))


class WordCache:
    """``encode`` turns a list of strings into a list of bytes (ids as little-endian uint32).

    The cache holds at most ``CACHE_SIZE`` words or, where ``most_bytes`` is given, as many as
    fit in that many bytes.
    """

    def __init__(self, encode, whole=None, most_bytes=None):
        self.encode = encode
        self.whole = whole  # texts for which this says true are encoded whole
        self.known: dict = {}
        self.most_bytes = most_bytes
        self.used = 0  # words, or bytes where most_bytes is given

    @property
    def bytes(self) -> int:
        return self.used if self.most_bytes else 0

    def _size(self, words) -> int:
        return len(words) if self.most_bytes is None else cost(words)

    def _learn(self, words) -> dict:
        """Ids of the words, all unknown; they are kept where there is room."""
        known, found = self.known, {}
        parts = {w: (stem, w[len(stem):]) for w in words if (stem := _stem(w))}
        new = {w: None for w in words if w not in parts}
        new.update((x, None) for both in parts.values() for x in both if x not in known)
        found.update(zip(new, self.encode(list(new))))
        for w, (stem, signs) in parts.items():
            found[w] = (found.get(stem) or known[stem]) + (found.get(signs) or known[signs])
        short = {w: v for w, v in found.items() if len(w) <= CACHED_CHARS}
        size = self._size(short)
        if self.used + size <= (self.most_bytes or CACHE_SIZE):
            known.update(short)
            self.used += size
        else:
            # the words met first are the frequent ones: they stay, the later half goes
            kept = (len(known) if self.most_bytes else CACHE_SIZE) // 2
            self.known = dict(islice(known.items(), kept))
            self.used = self._size(self.known)
        return found

    def ids(self, batch):
        """Ids of each text as bytes.

        The words of the batch are numbered by Arrow, so only its distinct ones pass through
        the cache, and their ids are strung together by Arrow as well.
        """
        out, plain, odd = [b""] * len(batch), [], []
        for at, text in enumerate(batch):
            if text:
                whole = (self.whole and self.whole(text)) or not splits(text)
                (odd if whole else plain).append(at)
        if plain:
            words = pc.split_pattern(marked(pa.array([batch[i] for i in plain],
                                                     pa.large_string())), "\0")
            numbered = words.values.dictionary_encode()
            distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = list(map(self.known.get, distinct))
            missing = [i for i, v in enumerate(ids) if v is None]
            if missing:
                found = self._learn([distinct[i] for i in missing])
                for i in missing:
                    ids[i] = found[distinct[i]]
            strung = pa.array(ids, pa.large_binary()).take(numbered.indices)
            _, ends, data = strung.buffers()
            ends = np.frombuffer(ends, np.int64)[np.asarray(words.offsets)].tolist()
            data = memoryview(data) if data else b""
            for at, a, b in zip(plain, ends, ends[1:]):
                out[at] = bytes(data[a:b])
        for at, ids in zip(odd, self.encode([batch[i] for i in odd]) if odd else ()):
            out[at] = ids
        return out

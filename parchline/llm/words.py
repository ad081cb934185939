"""Token ids of texts word by word, for byte-level BPE whose split pattern lets a word begin with a space."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KNOWN_WORDS = 1_000_000
LONGEST_WORD = 64
# Stands between words while a batch is cut; texts that hold it are tokenized whole.
MARK = "\x01"
SPACED = re.compile(r"\s (?:\s|\Z)")


class Words:
    """Looks up the ids of words and tokenizes only new ones.

    The split pattern takes a single space along with the word after it, and no alternative of it looks
    back, so a text can be cut before a space without changing its tokens unless white space is on
    both sides of that space. Texts with such places are tokenized whole. At most ``most`` words of
    up to ``LONGEST_WORD`` characters are kept.
    """

    def __init__(self, tokenize: Callable[[list[str]], list[bytes]], most: int = KNOWN_WORDS) -> None:
        self.tokenize, self.most = tokenize, most
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids of the whole text, in the machine's byte order (little-endian)."""
        if SPACED.search(text):
            return self.tokenize([text])[0]
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        new = list({p for p in parts if p not in known})
        fresh = dict(zip(new, self.tokenize(new), strict=True))
        out = b"".join([fresh[p] if p in fresh else known[p] for p in parts])
        known.update((p, i) for p, i in fresh.items() if len(p) <= LONGEST_WORD)
        return out

    def ids_of(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each whole text of a batch.

        Arrow cuts the texts and numbers their distinct words, so Python sees each word of a batch once, and the ids are
        gathered from one buffer.
        """
        whole = [row for row, text in enumerate(texts.to_pylist()) if MARK in text or SPACED.search(text)]
        plain = texts
        if whole:
            keep = np.ones(len(texts), bool)
            keep[whole] = False
            plain = pc.if_else(pa.array(keep), texts, "")
        pieces = pc.split_pattern(pc.replace_substring(plain, " ", MARK + " "), MARK)
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        fresh = dict(zip(new, self.tokenize(new), strict=True))
        parts = [fresh[w] if w in fresh else known[w] for w in words]
        if len(known) > self.most:
            known.clear()
        known.update((w, i) for w, i in fresh.items() if len(w) <= LONGEST_WORD)
        pool = np.frombuffer(b"".join(parts), np.uint32)
        # A part of some megabytes has fewer ids than 32 bits can count.
        sizes = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        place = coded.indices.to_numpy()
        own = sizes[place]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(own, dtype=np.int32)])
        at = np.repeat(starts[place] - ends[:-1], own)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = pool[at]
        bounds = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for row in whole:
            out[row] = np.frombuffer(self.tokenize([texts[row].as_py()])[0], np.uint32)
        return out

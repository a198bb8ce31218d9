"""Subword ids of whole texts, each distinct word encoded once per process."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words whose ids a process keeps (some 200 MB); beyond it the memory is
#: emptied and fills again.
KEPT_WORDS = 1_000_000
JOINED = 128


class WordCoder:
    """Ids as the tokenizer file gives them, for tokenizers whose tokens never
    reach over a space or line end (they then may be encoded word by word)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for part, got in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.cumsum([len(w) + 1 for w in part])
            at = np.searchsorted(ends, np.array([o[0] for o in got.offsets], np.int64), side="right")
            cuts = np.searchsorted(at, np.arange(len(part) + 1))
            data = ids.tobytes()
            for w, x, y in zip(part, cuts.tolist(), cuts[1:].tolist(), strict=False):
                self.ids[w] = data[4 * x : 4 * y]

    def encode(self, text: str) -> bytes:
        """The ids, each as a little-endian unsigned 32-bit number."""
        words = text.replace("\n", " ").split(" ")
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
        got = list(map(self.ids.get, words))
        if None in got:
            unknown = [i for i, g in enumerate(got) if g is None]
            self._learn(list({words[i] for i in unknown}))
            for i in unknown:
                got[i] = self.ids[words[i]]
        return b"".join(got)


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    """The process's coder for a tokenizer file."""
    return WordCoder(path)

"""Token ids from a public tokenizer file, fast enough for whole corpora.

The word vocabulary's pre-tokenizer drops white space and never joins across it, and it parts letters and digits from
the symbols behind them. So a text's ids are those of its space-separated words in turn, where ASCII punctuation
at a word's end counts as a word of its own. Each Python worker remembers the ids of words it has met, up to a
fixed number; words it has not met are encoded together in one call of the library. Whether a file has these
properties is read from it; texts are given to the library whole where it has not.
"""

from __future__ import annotations

import os
import re
from typing import Any

from .common import worker_cache

#: Words whose ids a worker remembers, and the longest word that it remembers.
CACHE_WORDS, CACHE_LENGTH = 600_000, 32
#: ASCII punctuation between a letter or digit and a space.
WORD_END = r"(?<=[^\W_])([!-/:-@\[-`{-~]+)(?= )"


#: The steps of a tokenizer file that works word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def works_by_words(path: str) -> bool:
    """Whether the file's normaliser, pre-tokenizer and model give a text's ids word by word."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    byte_level = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
    return spec.get("normalizer") == NORMALIZER and steps[0] == split and byte_level and spec["model"].get("end_of_word_suffix") == "</w>"


def default_tokenizer() -> str:
    """The word-level BPE file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """encode_many(texts) gives little-endian unsigned 32-bit ids as bytes, one string of them per text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.wordwise = works_by_words(path)
        self.known: dict[str, bytes] = {"": b""}
        self.part = re.compile(WORD_END).sub
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        try:  # the tokenizer lower-cases; within Latin-1 that is surely the same here, and fewer words differ
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return self.part(r" \1", text.replace("\n", " ") + " ").split(" ")

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Words of letters alone are one pre-token each, which ends with its only end-of-word token."""
        import numpy as np

        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        fresh = dict(zip(odd, self.whole(odd), strict=True)) if odd else {}
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(part) or stops[-1] != len(ids) * 4:
                fresh |= zip(part, self.whole(part), strict=True)
                continue
            raw, start = ids.tobytes(), 0
            for word, stop in zip(part, stops, strict=True):
                fresh[word] = raw[start:stop]
                start = stop
        if len(self.known) + len(fresh) <= CACHE_WORDS:
            self.known |= ((w, ids) for w, ids in fresh.items() if len(w) <= CACHE_LENGTH)
        return fresh

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.wordwise:
            return self.whole(texts)
        known = self.known.get
        split = [self.split(t) for t in texts]
        rows = [list(map(known, words)) for words in split]
        gaps, missing = [], set()
        for words, row in zip(split, rows, strict=True):
            gap, i = [], -1
            try:
                while True:
                    i = row.index(None, i + 1)
                    gap.append(i)
                    missing.add(words[i])
            except ValueError:
                gaps.append(gap)
        if missing:
            fresh = self._learn(missing)
            for words, row, gap in zip(split, rows, gaps, strict=True):
                for i in gap:
                    row[i] = fresh[words[i]]
        return [b"".join(row) for row in rows]


def encoder(path: str) -> ChunkEncoder:
    return worker_cache(f"encoder:{path}", lambda: ChunkEncoder(path), large=True)


def text_groups(texts: list[Any], limit: int = 1_000_000) -> list[list[int]]:
    """Indices of texts in runs of at most about `limit` characters, so that one call stays small."""
    groups, size = [[]], 0
    for i, t in enumerate(texts):
        if groups[-1] and size + len(t) > limit:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(t)
    return [g for g in groups if g]

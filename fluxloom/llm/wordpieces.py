"""Token ids of whole texts through the tokenizers library, each distinct word encoded once per worker.

The vocabulary is one of BPE with word ends: its pre-tokenizer drops white space and never joins across it, so the ids
of a text are those of its words one after the other. Words are kept with their ids; a new word of plain letters, with
ASCII marks behind, is put together from the ids of its letters and of its marks, which the pre-tokenizer would cut
apart too. New letters are encoded many at a time without the normaliser, which changes nothing there but case. Any
other new word goes through the library as it is. The store of words is emptied when it is full, which bounds the
memory and changes no result.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

FULL = 400_000  # words
FULL_PARTS = 800_000
LINE = 2048
#: Every line of lower-cased words: letters and marks, or anything else.
PLAIN = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|(.*))$", re.MULTILINE)
WORD_END = "</w>"


class WordEncoder:
    """``encode`` gives each text's ids as little-endian 16-bit (or 32-bit) numbers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        if json.loads(self.library.to_str())["model"].get("end_of_word_suffix") != WORD_END:
            raise ValueError("a vocabulary with word ends is needed")
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        out = []
        lines = [words[at : at + LINE] for at in range(0, len(words), LINE)]
        coded = self.bare.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        for line, code in zip(lines, coded):
            ids = np.array(code.ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(line):
                out += self._library(line)
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            edges = [0, *(stops * size).tolist()]
            out += [raw[a:z] for a, z in zip(edges, edges[1:])]
        return out

    def _learn(self, new: list[bytes]) -> None:
        if len(self.parts) > FULL_PARTS:
            self.parts.clear()
        cut = PLAIN.findall(b"\n".join(new).decode().lower())
        parts = self.parts
        letters = list({x[0] for x in cut if x[0]}.difference(parts))
        parts.update(zip(letters, self._letters(letters)))
        marks = list({x[1] for x in cut}.difference(parts))
        parts.update(zip(marks, self._library(marks)))
        self.words.update([(word, parts[x[0]] + parts[x[1]]) for word, x in zip(new, cut) if x[0]])
        other = [word for word, x in zip(new, cut) if not x[0]]
        self.words.update(zip(other, self._library([word.decode() for word in other])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.words)
        if new:
            if len(self.words) + len(new) > FULL:
                self.words.clear()
                new = distinct
            gc.disable()  # many short-lived tuples, no cycles
            self._learn(list(new))
            gc.enable()
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary file."""
    return WordEncoder(path)

"""Token ids of whole texts.

The tokenizer drops white space and never merges across it, so a text's ids are those of
its words in order. Each task encodes a distinct word once and looks up the rest.
"""

from __future__ import annotations

import os
import string
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidegauge.llm.common import by_value, words_of

SLICE_BYTES = 16_000_000
KEPT_WORDS = 600_000
_CHUNK = 1000


def encoder(path: str, end: int | None = 1) -> Encoder:
    """This process's encoder: Spark uses a Python worker for many tasks, which share what it has learnt."""
    kept = sys.modules.setdefault("_tidegauge_encoders", types.ModuleType("_tidegauge_encoders")).__dict__
    if (path, end) not in kept:
        kept[path, end] = Encoder(path, end)
    return kept[path, end]


class Encoder:
    """Encodes Arrow arrays of texts; ``end`` is appended to every text.

    At most about ``keep`` distinct words are remembered from one call to the next; what
    is forgotten is encoded again. Known words are an Arrow array, their ids one flat
    array, so that no Python object is made for a word that is known.
    """

    def __init__(self, path: str, end: int | None = 1, keep: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.keep = Tokenizer.from_file(path), end, keep
        self._forget()

    def _forget(self) -> None:
        """Known are the empty word, and under a name that no word can have, the end."""
        ends = [] if self.end is None else [self.end]
        self.words = pa.array(["", " "], pa.string())
        self.sizes, self.flat = np.array([0, len(ends)], np.int64), np.array(ends, np.uint32)
        self.starts = np.zeros(2, np.int64)

    def _add(self, words: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known ones; -1 if unknown."""
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1), np.int64)

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words one after the other, and the first of each word."""
        counts = self.sizes[codes]
        before = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((self.starts[codes] - before[:-1]).astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], before

    def _encode(self, units: pa.Array) -> None:
        """Ask the tokenizer for units and remember them."""
        letters = pc.utf8_is_alpha(units)
        alone = units.filter(pc.invert(letters)).to_pylist()
        plain = units.filter(letters).to_pylist()
        # A unit of letters stays whole, so many are encoded as one text.
        for i in range(0, len(plain), _CHUNK):
            some = plain[i : i + _CHUNK]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            unit = np.array(e.word_ids, np.int64)
            if len(unit) and unit[-1] + 1 == len(some):
                self._add(pa.array(some), np.bincount(unit, minlength=len(some)), np.array(e.ids, np.uint32))
            else:  # it takes some letter for something else
                alone += some
        for i in range(0, len(alone), _CHUNK):
            some = alone[i : i + _CHUNK]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            flat = np.array([x for ids in found for x in ids], np.uint32)
            self._add(pa.array(some), np.array([len(ids) for ids in found], np.int64), flat)

    def _learn(self, words: pa.Array) -> None:
        # Letters and the punctuation that follows them are separate units.
        stems = pc.ascii_rtrim(words, characters=string.punctuation)
        stems = pc.if_else(pc.utf8_is_alpha(stems), stems, words)
        tails = pa.array([w[len(s) :] for w, s in zip(words.to_pylist(), stems.to_pylist())], pa.string())
        units = pc.unique(pa.concat_arrays([stems, tails]))
        self._encode(units.filter(pa.array(self._codes(units) < 0)))
        pairs = np.stack([self._codes(stems), self._codes(tails)], axis=1)
        flat, _ = self._ids(pairs.ravel())
        cut = pairs[:, 1] > 0
        if cut.any():
            sizes = self.sizes[pairs].sum(axis=1)
            self._add(words.filter(pa.array(cut)), sizes[cut], flat[np.repeat(cut, sizes)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each text and one past the last)."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # as the tokenizer does, but for the strings of special tokens
        codes, distinct, bounds = words_of(texts)
        if len(self.words) > self.keep:
            self._forget()
        places = self._codes(distinct)
        if (places < 0).any():
            self._learn(distinct.filter(pa.array(places < 0)))
            places = self._codes(distinct)
        codes = places[codes]
        if self.end is not None:
            codes = np.insert(codes, bounds[1:], 1)
            bounds = bounds + np.arange(len(bounds))
        ids, before = self._ids(codes)
        return ids, before[bounds]


by_value(__name__)

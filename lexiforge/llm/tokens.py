"""Batch tokenisation with the tokenizers library.

The vocabulary's pre-tokenizer never lets a token cross white space and drops it, so a text's ids
are those of its white-space-separated pieces in order.  It also starts a new token where
punctuation follows a letter or digit, and lower-cases, so a piece's ids are those of its
lower-cased stem and of the punctuation at its end.  The library encodes each distinct stem and
ending once; the worker remembers them, up to a bound that is a parameter, and ids are gathered
with numpy.  A stem of letters is one word to the vocabulary, whose last id, and no other, has the
suffix that ends a word; so many such stems are encoded as one text and cut at those ids.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, split_words


#: What may be cut off a piece's end, and what must then stand before it.  U+0130 is not among it: lower-cased
#: it ends in a combining dot, which the library joins with the punctuation.
ENDINGS, BEFORE = ".,;:!?", r"[0-9A-Za-zÀ-ÖØ-öø-\x{12F}\x{131}-ɏ]$"


#: What is one word to the pre-tokenizer, as it is to remain when composed and lower-cased.
LETTERS = r"^[A-Za-zÀ-ÖØ-öø-\x{12F}\x{131}-ɏ]+$"
#: Stems of letters that are encoded as one text.
LINE = 64
#: Pieces that a worker remembers, about 200 bytes each.
MAX_PIECES = 1_200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes arrays of texts; remembers the ids of about max_pieces pieces."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        # Of each id whether it ends a word; without a suffix for that, or with ids dropped at random, no id tells.
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix and not self.tokenizer.model.dropout:
            self.ends[[k for name, k in vocabulary.items() if name.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many of each text)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces in some order, where each piece's start, how many they are)."""
        plain = pc.match_substring_regex(pa.array(pieces, pa.string()), LETTERS).to_numpy(zero_copy_only=False)
        words = list(compress(pieces, plain))
        ids, _ = self._each([" ".join(words[k : k + LINE]) for k in range(0, len(words), LINE)])
        ends = np.flatnonzero(self.ends[ids])
        # A word has one end at most, so with as many ends as words each has its own.
        if len(ends) != len(words):
            ids, counts = self._each(pieces)
            return ids, np.cumsum(counts) - counts, counts
        other, others = self._each(list(compress(pieces, ~plain)))
        counts = np.empty(len(pieces), np.int64)
        counts[plain], counts[~plain] = np.diff(ends, prepend=-1), others
        starts = np.empty(len(pieces), np.int64)
        starts[plain], starts[~plain] = ends + 1 - counts[plain], len(ids) + np.cumsum(others) - others
        return np.concatenate([ids, other]), starts, counts

    def _learn(self, pieces: list[str]) -> None:
        flat, starts, counts = self._encoded(pieces)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + starts])
        self.counts = np.concatenate([self.counts, counts])
        self.used += len(flat)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))

    def _at(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of each part are; parts not known yet are learned."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = list(map(self.known.get, names))
        new = [p for p, k in zip(names, found, strict=True) if k is None]
        if new:
            fresh = iter(range(len(self.known), len(self.known) + len(new)))
            found = [next(fresh) if k is None else k for k in found]
            self._learn(new)
        return np.array(found, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces in order, starts, counts)."""
        if len(self.known) > self.max_pieces:
            self._forget()
        special = pc.match_substring(distinct, "<|")
        lowered = pc.if_else(pc.and_not(pc.string_is_ascii(distinct), special), pc.ascii_lower(distinct), distinct)
        stem = pc.utf8_rtrim(lowered, ENDINGS)
        stem = pc.if_else(pc.and_not(pc.match_substring_regex(stem, BEFORE), special), stem, lowered)
        # Endings are ASCII, so bytes count their characters.
        length = pc.subtract(pc.binary_length(lowered), pc.binary_length(stem)).to_numpy(zero_copy_only=False)
        ended = np.flatnonzero(length)
        endings = pa.array([p[-k:] for p, k in zip(lowered.take(pa.array(ended)).to_pylist(), length[ended].tolist(), strict=True)], pa.string())
        first = self._at(stem)
        second = np.full(len(distinct), -1)
        second[ended] = self._at(endings)
        pair = np.stack([first, second], axis=1).ravel()
        counts = np.where(pair >= 0, self.counts[pair], 0)
        ids = self.ids[ranges(self.starts[pair], counts)]
        counts = counts.reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(counts) - counts, counts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, each text's followed by end_id; the texts' bounds)."""
        n = len(texts)
        words, rows = split_words(texts)
        coded = words.dictionary_encode()
        ids, starts, lengths = self._pieces(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[at]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, counts, n).astype(np.int64) + 1)])
        out = np.empty(bounds[-1], np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[bounds[1:] - 1] = True
        out[is_end] = end_id
        out[~is_end] = ids[ranges(starts[at], counts)]
        return out, bounds


def encoder(path: str, max_pieces: int = MAX_PIECES) -> Encoder:
    """This process's encoder for path; later tasks of the same worker use it again."""
    held = sys.modules.setdefault("_lexiforge_held", types.ModuleType("_lexiforge_held"))
    if getattr(held, "key", None) != (path, max_pieces):
        held.key, held.encoder = (path, max_pieces), Encoder(path, max_pieces)
    return held.encoder

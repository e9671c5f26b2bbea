"""Ids of whole texts by a public tokenizer, with each distinct word encoded once a worker.

The tokenizer normalises to NFC, lower-cases, drops white space and cuts between letters and punctuation, so a text's
ids are those of its words one after another. Texts are cut at white space and between a letter and ``.,!?;:``, distinct
words are encoded and ids put together again. This holds for texts of printable Latin-1 characters, tabs and line ends
without ``<|``; all others go through the tokenizer as they are. Tests compare both ways. A word of ASCII letters is what the
normaliser and the cutting leave of it, so such words go to the tokenizer's model at once, parted by spaces.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN_WORD = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Words that are encoded as one text: the time of a long text grows faster than its length.
_AT_ONCE = 200
_OTHER = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ff}]|<\|"
MOST_WORDS = 200_000


class WordEncoder:
    """most: words that are held at once; beyond, all are forgotten."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = self._cuts_at_words()
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self._forget()

    def _cuts_at_words(self) -> bool:
        """Whether this tokenizer is of the kind that the module describes."""
        probe = "It's a Test, of 12 words!? Où été (ça) x.y ...z\n'tis"
        words = re.sub(f"([{_LETTERS}])([.,!?;:])", r"\1 \2", probe).split()
        return sum((self.direct([w])[0] for w in words), []) == self.direct([probe])[0]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.empty(0, np.uint32)]
        self.sizes = [np.empty(0, np.int64)]

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @functools.cached_property
    def bare(self):
        """The tokenizer's model behind a cut at spaces, for words of lower-case ASCII letters."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = "a test of words with letters qzxv"
        return bare if bare.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids else self.tokenizer

    def _learn(self, words: list[str]) -> None:
        other = []
        ascii_, latin = [], []
        for w in words:
            (other if not _PLAIN_WORD(w) else ascii_ if w.isascii() else latin).append(w)
        for tokenizer, plain in ((self.bare, ascii_), (self.tokenizer, latin)):
            parts = [plain[i : i + _AT_ONCE] for i in range(0, len(plain), _AT_ONCE)]
            for part, found in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.uint32)
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) != len(part):
                    other += part
                    continue
                self._keep(part, ids, np.diff(last, prepend=0))
        for i in range(0, len(other), 2000):
            part = self.direct(other[i : i + 2000])
            self._keep(other[i : i + 2000], np.array([x for p in part for x in p], np.uint32), list(map(len, part)))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: list[int] | np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.flat.append(ids)
        self.sizes.append(np.asarray(sizes, np.int64))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        odd = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)
        if not self.by_words:
            odd[:] = True
        for i, ids in zip(np.flatnonzero(odd), self.direct(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            out[i] = np.array(ids, np.uint32)
        rest = np.flatnonzero(~odd)
        if not len(rest):
            return out
        cut = pc.replace_substring_regex(texts.take(pa.array(rest)), f"([{_LETTERS}])([.,!?;:])", r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(cut))
        edges = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        values = words.dictionary.to_pylist()
        new = [w for w in values if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self._forget()
            new = values
        if new:
            self._learn(new)
        if len(self.flat) > 1:
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        sizes = self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        which = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))[words.indices.to_numpy()]
        n = sizes[which]
        ends = np.cumsum(n)
        flat = self.flat[0][np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][edges - edges[0]]
        for i, a, b in zip(rest, bounds[:-1], bounds[1:], strict=True):
            out[i] = flat[a:b]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One a worker process."""
    return WordEncoder(path, 3 * MOST_WORDS)

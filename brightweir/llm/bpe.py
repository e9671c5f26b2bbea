"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked list of symbols, and decoding.

A piece starts as its characters, the last with the end-of-word mark. The queue holds (rank, place of the left symbol); the
lowest rank is merged first, from left to right, and the pairs at both ends of the merged symbol enter the queue. An entry
whose place holds another pair by then is stale and skipped. Each distinct word is encoded once a worker and texts are put
together from the words' ids (see words_bpe); texts that cannot be cut so are cut into pieces by the tokenizer's own
normaliser and pre-tokenizer, between the special tokens that they hold. Decoding concatenates the vocabulary's strings,
with a space between, as this kind of file names no decoder.

All is one pass without a shuffle; a worker holds the vocabulary and at most ``MOST_WORDS`` words. Null texts count as
empty; an empty text has no ids and decodes to an empty text. Repeated rows each get their own result; columns of the names
added are replaced; empty tables give empty results. Long words take time in proportion to n log n.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brightweir.llm.arrow import appended, pieces
from brightweir.llm.words_bpe import MOST_WORDS, WordEncoder
from brightweir.session import table

#: Fixed values of the tokenizer's pre-tokenizer, for words of lower-case ASCII.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall


class Merges:
    """Merge ranks over ids."""

    def __init__(self, model: dict):
        if model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a byte-level model")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])

    def ids(self, piece: str) -> list[int]:
        sym = [self.vocab[c] for c in piece[:-1]]
        sym.append(self.vocab[piece[-1] + self.end])
        n = len(sym)
        if n == 1:
            return sym
        rank, made = self.rank.get, self.made
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = right[i]
            if j >= n or rank((sym[i], sym[j])) != r:
                continue
            k = right[j]
            sym[i], sym[j], right[i] = made[r], -1, k
            right[j] = n  # a merged symbol has no pair
            if k < n:
                left[k] = i
                if (x := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(queue, (x, i))
            h = left[i]
            if h >= 0 and (x := rank((sym[h], sym[i]))) is not None:
                heapq.heappush(queue, (x, h))
        return [s for s in sym if s >= 0]


class HeapEncoder(WordEncoder):
    """Texts cut at words as WordEncoder does, every piece merged by the queue."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.pieces: dict[str, list[int]] = {}
        self.special: dict[str, int] = {}
        super().__init__(path)

    def _cuts_at_words(self) -> bool:
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.normalized or token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"{token} is matched in a way that is not supported")
            self.special[token.content] = i
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        names = dict(self.tokenizer.get_vocab(with_added_tokens=True))
        self.tokens = [""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.tokens[i] = token
        self.strings = pa.array(self.tokens)
        probe = "it's a test, of 12 words!? x.y ...z'tis a1b2 <|-#"
        alike = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == _ASCII_PIECES(probe)
        return alike and super()._cuts_at_words()

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merges.ids(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= MOST_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [[i for part in self.cut(t) for i in self._part(part)] for t in texts]

    def _part(self, part: str) -> Iterator[int]:
        if part in self.special:
            yield self.special[part]
        elif part:
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                yield from self._piece(piece)

    def _learn(self, words: list[str]) -> None:
        found = [[i for p in _ASCII_PIECES(w) for i in self.merges.ids(p)] if w.isascii() and self.by_words else self.direct([w])[0] for w in words]
        self._keep(words, np.array([x for f in found for x in f], np.uint32), list(map(len, found)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; ids beyond the vocabulary are an error, null lists give null."""
        flat = self.strings.take(ids.flatten())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))].astype(np.int32)), flat)
        joined = pc.binary_join(lists, " ")
        return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.string()), joined)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> HeapEncoder:
    """One a worker process."""
    return HeapEncoder(path)


_KINDS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """docs with the columns asked for: n_tokens, ids, ids_sha256 (of little-endian unsigned 32-bit integers), decoded (the text
    that the ids decode to) and decoded_sha256 (of its UTF-8 bytes)."""
    docs = docs.drop(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in pieces(whole, text_col):
                ids = bpe.encode(batch[text_col])
                made = {"n_tokens": lambda ids=ids: pa.array([len(x) for x in ids], pa.int64()), "ids": lambda ids=ids: _lists(ids), "ids_sha256": lambda ids=ids: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string())}
                if "decoded" in columns or "decoded_sha256" in columns:
                    decoded = bpe.decode(_lists(ids))
                    made["decoded"] = lambda d=decoded: d
                    made["decoded_sha256"] = lambda d=decoded: pa.array([hashlib.sha256(x).hexdigest() for x in d.cast(pa.binary()).to_pylist()], pa.string())
                yield appended(batch, **{c: made[c]() for c in columns})

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], *[f"{c} {_KINDS[c]}" for c in columns]]))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of an array of ids; null for null."""
    rows = rows.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            yield appended(batch, **{text_col: bpe.decode(batch[ids_col])})

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{text_col}` string"]))


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), columns=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")

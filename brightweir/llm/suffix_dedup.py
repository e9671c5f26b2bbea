"""Removal of byte strings that occur more than once in a corpus.

A string of ``min_len`` bytes that starts at two places (in one document or in two) is removed wherever it occurs;
occurrences may overlap and never cross documents. The suffixes that can take part are found with a difference cover
and sorted bucket by bucket:

1. *Cover sample.* D is a perfect difference set modulo v. Whatever two positions i and j are compared, some shift
   below v takes both of them into the sample {p : p mod v in D}, so of two equal strings of ``min_len`` bytes, two
   sample suffixes agree in their first ``min_len - v + 1`` bytes. Only sample suffixes are ranked in this pass, and
   only those whose rank is shared are passed on.
2. *Blockwise sort.* A suffix that has no shared sample rank among its next v positions cannot have a twin. The others
   are dealt to buckets, and each bucket is sorted on its own, so that a task holds one bucket. Equal neighbours are
   the repeated strings.

Both passes order suffixes by a fingerprint of the compared bytes (with the bucket, over 64 bits in the second pass)
rather than byte by byte: the depth is fixed, so only the adjacency of equal strings counts, and records need no text.
Nothing is compared byte by byte after that. Fingerprints are polynomial prefix sums, so a window costs two lookups at
any depth; modulo 2^64 these have structured collisions only for strings longer than the ones compared here. Repeats
inside one task are settled there and reach a bucket once, which bounds what a very common passage sends to one bucket
by the number of tasks. Texts that are equal as a whole are one class and are worked on once; texts are shuffled once,
compressed, and all passes read that shuffle.

*Passages.* With ``passage_words``, the same two passes run over word windows of that length, to tell which words of a
document stand in a passage that another document has too. The first pass ranks window minima instead of a cover: of the
``passage_words - ANCHOR + 1`` runs of ``ANCHOR`` words in a window the one with the smallest fingerprint, which is the same one in every
copy. What a document itself has twice counts where it stands first. Byte removal does not depend on this.

Nulls count as empty; repeated rows are copies of each other; a text below ``min_len`` keeps all its bytes; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
SHARE = 2
#: Words of the runs whose minima stand for passages.
ANCHOR = 21
#: Bytes of a text's name, its MD5.
NAME = 16
FLUSH = 2_000_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_MARKS = "bucket int, fp binary, docs binary, counts binary, pos binary"


@functools.lru_cache
def difference_cover(min_len: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): the largest Singer difference set that leaves half of min_len to compare; (1, (0,)) for short ones."""
    best = (1, (0,))
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43):
        v = q * q + q + 1
        if min_len - v + 1 < max(4, min_len // SHARE):
            break
        best = (v, _singer(q, v))
    return best


def _singer(q: int, v: int) -> tuple[int, ...]:
    """Exponents i at which x^i has no square term in GF(q)[x] modulo a cubic; the cubic is searched for."""
    for code in range(q**3):
        a, b, c = code // q // q, code // q % q, code % q
        x, found = (1, 0, 0), []  # constant, linear, square
        for i in range(v):
            if x[2] == 0:
                found.append(i)
            x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
        if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
            return tuple(found)
    raise ValueError(f"no difference set for {q}")


@functools.lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of the base and of its inverse modulo 2^64."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = PIECE + 1
    powers, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return values, np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def fingerprints(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """64-bit fingerprints of text[s : s + depth] for the sorted starts; long texts are gone through in pieces.

    text: bytes, or 64-bit values of words."""
    values, powers, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    step = PIECE - depth
    for at in range(0, int(starts[-1]) + 1 if len(starts) else 0, step):
        lo, hi = np.searchsorted(starts, (at, at + step))
        if lo == hi:
            continue
        piece = text[at : at + PIECE]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((values[piece] if text.dtype == np.uint8 else piece) * powers[: len(piece)], out=sums[1:])
        s = starts[lo:hi] - at
        out[lo:hi] = (sums[s + depth] - sums[s]) * inverse[s]
    return _stirred(out)


def _stirred(out: np.ndarray) -> np.ndarray:
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def word_values(text: bytes) -> np.ndarray:
    """An odd 64-bit value of each word (runs between ASCII white space)."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | np.uint64(1)


def minima(prints: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` prints the place of its smallest, the last one if even."""
    n = len(prints) - width + 1
    best, step = np.arange(len(prints)), 1
    while step < width:  # best[i]: of the next min(2 * step, width) prints
        hop = min(step, width - step)
        a, b = best[: len(best) - hop], best[hop:]
        best, step = np.where(prints[b] <= prints[a], b, a), step + hop
    return best[:n]


def _packed(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def _unpacked(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that compression sees the zeros of small numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return doc[first], np.diff(np.r_[first, len(doc)])


def _pack(bucket: int, fp: np.ndarray | None, ids: list[bytes], doc: np.ndarray, pos: np.ndarray) -> tuple:
    """doc and pos in the order of documents; fp None: known to be repeated."""
    which, counts = _runs(doc)
    return (
        bucket,
        None if fp is None else fp.tobytes(),
        b"".join(ids[i] for i in which),
        _packed(_planes(counts.astype(np.uint32))),
        _packed(_planes(np.diff(pos.astype(np.int64), prepend=0).astype(np.int32))),
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    bucket, fp, docs, counts, pos = zip(*rows, strict=True)
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((bucket, fp, docs, counts, pos), kinds, strict=True)], ["bucket", "fp", "docs", "counts", "pos"])


class _Deal:
    """Collects suffixes of a task, settles repeats among them, and deals one of each fingerprint to its bucket."""

    def __init__(self, buckets: int, kind):
        self.buckets, self.kind, self.ids = buckets, kind, []
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, doc_id: bytes, keys: np.ndarray, pos: np.ndarray) -> bool:
        self.parts.append((keys, np.full(len(keys), len(self.ids), np.int32), pos.astype(np.int64)))
        self.ids.append(doc_id)
        self.n += len(keys)
        return self.n >= FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.r_[True, ordered[1:] != ordered[:-1]]
        lone = fresh & np.r_[fresh[1:], True]
        sure = np.ones(len(keys), bool)
        sure[order[lone]] = False
        keep = np.zeros(len(keys), bool)
        keep[order[fresh]] = True
        rows = []
        at = np.flatnonzero(keep)
        bucket = ((keys[at] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if edges[b] < edges[b + 1]:
                own = at[by[edges[b] : edges[b + 1]]]
                # The bucket follows from the upper half; the lower bits tell its members apart, with the upper ones mixed in.
                rows.append(_pack(b, self.kind(keys[own]), self.ids, doc[own], pos[own]))
        told = np.flatnonzero(sure)
        for b, own in enumerate(np.array_split(told, min(self.buckets, 1 + len(told) // 4096))):
            if len(own):
                rows.append(_pack((b * 7919 + int(keys[own[0]] % np.uint64(9973))) % self.buckets, None, self.ids, doc[own], pos[own]))
        self.ids, self.parts, self.n = [], [], 0
        for i in range(0, len(rows), 64):
            yield _rows(rows[i : i + 64])


def _four(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u4")


def _six(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _eight(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u8")


_WIDTH = {_four: 4, _six: 6, _eight: 8}


def _numbers(fp: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(fp, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _dealer(buckets: int, depth: int, kind, starts, of_words: bool = False):
    """mapInArrow function over (h, text, ...): starts(row, symbols) gives the suffixes to deal.

    of_words: symbols are words, and each text deals a fingerprint once, so that equal ones are of different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Deal(buckets, kind)
        for batch in batches:
            for i in range(batch.num_rows):
                raw = _unpacked(batch["text"][i].as_py())
                if len(raw) < (2 * depth - 1 if of_words else depth):
                    continue
                text = word_values(raw) if of_words else np.frombuffer(raw, np.uint8)
                if len(text) < depth:
                    continue
                pos = starts(batch, i, text)
                if not len(pos):
                    continue
                keys = fingerprints(text, pos, depth)
                if of_words:
                    first = np.sort(np.unique(keys, return_index=True)[1])
                    keys, pos = keys[first], pos[first]
                if deal.add(batch["h"][i].as_py(), keys, pos):
                    yield from deal.flush()
        yield from deal.flush()

    return run


def _shared(kind):
    """applyInArrow function: the suffixes of one bucket whose fingerprint occurs again, by document."""
    width = _WIDTH[kind]

    def run(group: pa.Table) -> pa.Table:
        ids, docs, spots, keys, at = [], [], [], [], 0
        for fp, d, c, p in zip(*(group[x].to_pylist() for x in ("fp", "docs", "counts", "pos")), strict=True):
            counts = _unplanes(_unpacked(c), np.uint32).astype(np.int64)
            ids += [d[i : i + NAME] for i in range(0, len(d), NAME)]
            docs.append(np.repeat(np.arange(at, at + len(counts), dtype=np.int32), counts))
            at += len(counts)
            spots.append(np.cumsum(_unplanes(_unpacked(p), np.int32).astype(np.int64)))
            keys.append((_numbers(fp, width), len(spots) - 1) if fp is not None else None)
        dealt = [i for i, k in enumerate(keys) if k is not None]
        flags = [np.ones(len(s), bool) for s in spots]
        if dealt:
            key = np.concatenate([keys[i][0] for i in dealt])
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.r_[True, ordered[1:] != ordered[:-1]]
            twin = np.ones(len(key), bool)
            twin[order[fresh & np.r_[fresh[1:], True]]] = False
            edge = np.cumsum([0, *(len(spots[i]) for i in dealt)])
            for j, i in enumerate(dealt):
                flags[i] = twin[edge[j] : edge[j + 1]]
        doc, pos = np.concatenate([d[f] for d, f in zip(docs, flags, strict=True)]), np.concatenate([s[f] for s, f in zip(spots, flags, strict=True)])
        hs, ps = [], []
        if len(doc):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for lo, hi in zip(first, np.r_[first[1:], len(doc)], strict=True):
                hs.append(ids[doc[lo]])
                ps.append(_packed(_planes(np.diff(pos[lo:hi], prepend=0).astype(np.int32))))
        return pa.table({"h": pa.array(hs, pa.binary()), "pos": pa.array(ps, pa.binary())})

    return run


def _positions(blobs: list[bytes]) -> np.ndarray:
    if not blobs:
        return np.empty(0, np.int64)
    return np.unique(np.concatenate([np.cumsum(_unplanes(_unpacked(b), np.int32).astype(np.int64)) for b in blobs]))


def _spread(sorted_pos: np.ndarray, before: int, after: int) -> np.ndarray:
    """Maximal runs [lo, hi) of the union of [p - before, p + after)."""
    lo, hi = sorted_pos - before, sorted_pos + after
    cut = np.flatnonzero(lo[1:] > hi[:-1])
    return np.stack([lo[np.r_[0, cut + 1]], hi[np.r_[cut, len(hi) - 1]]], axis=1)


def _found(classes: DataFrame, dealt, kind) -> DataFrame:
    """(h, marks): packed starts of the suffixes that occur again, of each text that has any."""
    marks = classes.mapInArrow(dealt, _MARKS).groupBy("bucket").applyInArrow(_shared(kind), "h binary, pos binary")
    return marks.groupBy("h").agg(F.collect_list("pos").alias("marks"))


def repeated_spans(classes: DataFrame, min_len: int, buckets: int) -> DataFrame:
    """classes (h, text compressed, ...), one row a text: (h, marks), the packed starts of repeated strings.

    All of its columns go along, so that each use of classes is the same plan and reads the same shuffle."""
    v, cover = difference_cover(min_len)
    sampled = np.zeros(v, bool)
    sampled[list(cover)] = True

    def in_sample(_, __, text: np.ndarray) -> np.ndarray:
        at = np.arange(len(text) - (min_len - v + 1) + 1)
        return at[np.resize(sampled, len(at))]

    def near_shared(batch: pa.RecordBatch, i: int, text: np.ndarray) -> np.ndarray:
        anchors = _positions(batch["marks"][i].as_py())
        spans = np.clip(_spread(anchors, v - 1, 1), 0, len(text) - min_len + 1)
        return np.concatenate([np.arange(lo, hi) for lo, hi in spans]) if len(spans) else anchors

    cover_marks = _found(classes, _dealer(buckets, min_len - v + 1, _four, in_sample), _four)
    marked = classes.join(cover_marks, "h")
    # Fingerprints of this pass are twice as long.
    return _found(marked, _dealer(3 * buckets, min_len, _eight, near_shared), _eight)


def shared_passages(classes: DataFrame, n_words: int, buckets: int) -> DataFrame:
    """classes as above: (h, marks), the packed first words of windows of n_words words that another text has too."""
    anchor = min(ANCHOR, n_words)
    width = n_words - anchor + 1

    def prints(text: np.ndarray) -> np.ndarray:
        return fingerprints(text, np.arange(len(text) - anchor + 1), anchor)

    def anchors(_, __, text: np.ndarray) -> np.ndarray:
        return np.unique(minima(prints(text), width)) if len(text) >= n_words else np.empty(0, np.int64)

    def near_shared(batch: pa.RecordBatch, i: int, text: np.ndarray) -> np.ndarray:
        own = prints(text)
        return np.flatnonzero(np.isin(own[minima(own, width)], own[_positions(batch["marks"][i].as_py())]))

    marked = classes.join(_found(classes, _dealer(buckets, anchor, _four, anchors, True), _four), "h")
    return _found(marked, _dealer(buckets, n_words, _six, near_shared, True), _six)


def _compressed(text: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_packed(t) for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400, passage_words: int | None = None, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs of bytes, end
    exclusive); with passage_words, n_passage_words (words in windows of that many words that another row has too); and,
    if asked for, kept (the remaining bytes)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.unhex(F.md5("text")))
    base = base.where("h IS NOT NULL")  # always so; a join on h asks for it, and each use of the classes is to be one plan
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A bucket holds the sample suffixes of about 64 MB of text; the fewer buckets, the longer a document's runs in each.
    buckets = max(12, -(-total // (64 << 20)))
    classes = base.select("h", _compressed("text").alias("text")).groupBy("h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    found = classes.join(repeated_spans(classes, min_len, buckets).withColumnRenamed("marks", "pos"), "h", "left")
    if passage_words:
        found = found.join(shared_passages(classes, passage_words, buckets).withColumnRenamed("marks", "passages"), "h", "left")
    else:
        found = found.withColumn("passages", F.lit(None).cast("array<binary>"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, text, copies, blobs, passages in zip(*(batch[c].to_pylist() for c in ("h", "text", "copies", "pos", "passages")), strict=True):
                text = _unpacked(text)
                if copies > 1 and len(text) >= min_len:
                    spans = np.array([[0, len(text)]])
                else:
                    spans = _spread(_positions(blobs), 0, min_len) if blobs else np.empty((0, 2), np.int64)
                edges = [0, *spans.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n, n_words = int((spans[:, 1] - spans[:, 0]).sum()), 0
                if passage_words and copies > 1:
                    n_words = len(text.split())
                    n_words = n_words if n_words >= passage_words else 0
                elif passages:
                    n_words = int(np.diff(_spread(_positions(passages), 0, passage_words), axis=1).sum())
                out.append((h, len(text), n, len(spans), hashlib.sha256(kept).hexdigest(), n_words, [{"start": int(a), "end": int(b)} for a, b in spans], kept if keep_text else None))
            names = ("h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "spans", "kept")
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))

    done = found.select("h", "text", "copies", "pos", "passages").mapInArrow(
        cut, "h binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, spans array<struct<start: long, end: long>>, kept binary"
    )
    out = base.select("id", "h").join(done, "h").drop("h").withColumnRenamed("id", id_col)
    return out.drop(*[c for c, wanted in (("kept", keep_text), ("n_passage_words", passage_words)) if not wanted])


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and whether the document shares a passage of over 50 words with another."""
    from brightweir.session import table

    out = dedup_substrings(table(spark, sf_dir, "documents"), passage_words=51).drop("spans")
    return out.withColumn("repeats_passage", F.col("n_passage_words") > 0)

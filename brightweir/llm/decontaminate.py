"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised alike on both sides: ASCII letters in lower case, words are runs of digits, ASCII letters and
characters beyond ASCII. Every window of ``window`` consecutive words of an item is a pattern (an item of fewer words is one
pattern as a whole). The automaton's alphabet are the items' words, a character a word, and one more character for all other
words; a text is passed through it once. Matches end at word numbers, which are mapped to byte offsets of the original.

The benchmark comes to the driver in groups of at most ``max_bytes`` of item text, one group at a time; longer items are cut
into pieces that overlap by ``window`` - 1 words. A group's text, not its automaton, is sent to the tasks; each worker builds
it once (about 100 times the text, 400 MB at the default). With one group, the usual case, all is one pass over the texts
without a shuffle; with more, the rows are numbered in a table and each group is a job over the texts that writes the hits of
the rows it finds, so that one automaton at a time is held and texts are written once.

Null texts have no words. Items without words have no patterns. Items with equal ids count as one item; items whose id
is null hit words but are not listed. Repeated rows each get their own result. Empty tables give empty results, and an
empty benchmark contaminates nothing. Other columns pass through where rows are kept and are ignored otherwise.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightweir.llm.arrow import appended, as_bytes
from brightweir.session import scratch

#: Word bytes in lower case, everything else a space; bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Machine:
    """Automaton of a group of items, and the characters that stand for their words; code points of surrogates are left out."""

    def __init__(self, items: list[tuple], window: int):
        """items: (id, text as bytes)."""
        self.letters: dict[bytes, str] = {}
        patterns: dict[str, set] = {}
        for item, text in items:
            w = "".join(self._letter(x) for x in words(text))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                patterns.setdefault(w[i : i + window], set()).add(item)
        self.built = ahocorasick.Automaton()
        for p, ids in patterns.items():
            self.built.add_word(p, (len(p), ids))
        if patterns:
            self.built.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            n = len(self.letters) + 1
            self.letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return self.letters[word]

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set]:
        """(number of words, runs [first, last) of hit words, ids of the items found)."""
        w = words(text)
        none = np.empty((0, 2), np.int64)
        if not w or not len(self.built):
            return len(w), none, set()
        get, other = self.letters.get, "\0"
        runs, items = [], set()
        for end, (n, found) in self.built.iter("".join([get(x, other) for x in w])):
            runs.append((end + 1 - n, end + 1))
            items |= found
        return len(w), merged(np.array(runs, np.int64)) if runs else none, items


def merged(runs: np.ndarray) -> np.ndarray:
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    cut = np.flatnonzero(runs[1:, 0] > reach[:-1])
    return np.stack([runs[np.r_[0, cut + 1], 0], reach[np.r_[cut, len(runs) - 1]]], axis=1)


def original_spans(text: bytes, runs: np.ndarray) -> list[dict]:
    """Byte offsets in the original of runs of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs.tolist()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pieces(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """The text, or its normalised words in pieces of about ``most`` bytes that share ``window`` - 1 words."""
    if len(text) <= most:
        yield text
        return
    w, at = words(text), 0
    while at < len(w):
        end, size = at, 0
        while end < len(w) and (size < most or end - at < window):
            size += len(w[end]) + 1
            end += 1
        yield b" ".join(w[at:end])
        if end >= len(w):
            return
        at = end - window + 1


def _groups(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple]]:
    """Items in groups of about ``most`` bytes; at least one group, and one in memory at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).distinct()
    group, held = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        for piece in _pieces(bytes(r.t), window, most):
            if held and held + len(piece) > most:
                yield group
                group, held = [], 0
            group.append((r.i, piece))
            held += len(piece)
    yield group


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (byte offsets, end exclusive).

    Columns of these names are replaced."""
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    groups = _groups(benchmark, item_col, item_text_col, window, max_bytes)
    first, second = next(groups), next(groups, None)
    if second is None:
        found = _scanned(docs, first, text_col, window)
    else:
        found = _scanned_in_turn(docs, itertools.chain([first, second], groups), text_col, window)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hits, counts, digests, spans = [], [], [], [], []
            for text, flat, items in zip(as_bytes(batch[text_col]), batch["__hit_runs"].to_pylist(), batch["__hit_items"].to_pylist(), strict=True):
                runs = merged(np.array(flat, np.int64).reshape(-1, 2)) if flat else np.empty((0, 2), np.int64)
                own = sorted(set(items or ()))
                sizes.append(len(words(text)))
                hits.append(int((runs[:, 1] - runs[:, 0]).sum()))
                counts.append(len(own))
                digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                spans.append(original_spans(text, runs) if len(runs) else [])
            yield appended(
                batch.drop_columns(["__hit_runs", "__hit_items"]),
                n_words=pa.array(sizes, pa.int64()),
                n_hit=pa.array(hits, pa.int64()),
                n_items=pa.array(counts, pa.int64()),
                items_sha256=pa.array(digests),
                contaminated=pa.array([n > 0 for n in hits]),
                hit_spans=pa.array(spans, _SPANS),
            )

    return found.mapInArrow(finished, ", ".join([*_ddl(docs), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start: long, end: long>>"]))


_RUNS, _ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())


def _scanned(docs: DataFrame, items: list[tuple], text_col: str, window: int) -> DataFrame:
    """docs with what one group's automaton finds: __hit_runs (first and last word in turn) and __hit_items."""
    group, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine, runs, items = _machine(key, group, window), [], []
            for text in as_bytes(batch[text_col]):
                _, hit, found = machine.scan(text)
                runs.append(hit.ravel().tolist())
                items.append([x for x in found if x is not None])
            yield appended(batch, __hit_runs=pa.array(runs, _RUNS), __hit_items=pa.array(items, _ITEMS))

    return docs.mapInArrow(run, ", ".join([*_ddl(docs), "__hit_runs array<long>, __hit_items array<string>"]))


def _scanned_in_turn(docs: DataFrame, groups: Iterator[list[tuple]], text_col: str, window: int) -> DataFrame:
    """As _scanned, over many groups: rows are numbered in a table once, and each group's job writes only the numbers and
    findings of rows that it hits."""
    spark, rows, hits = docs.sparkSession, scratch(docs.sparkSession, "rows"), scratch(docs.sparkSession, "hits")
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(rows)
    numbered = spark.read.parquet(rows)
    for items in groups:
        found = _scanned(numbered.select("__row", text_col), items, text_col, window)
        found.where("size(__hit_runs) > 0").select("__row", "__hit_runs", "__hit_items").write.mode("append").parquet(hits)
    one = spark.read.parquet(hits).groupBy("__row").agg(F.flatten(F.collect_list("__hit_runs")).alias("__hit_runs"), F.flatten(F.collect_list("__hit_items")).alias("__hit_items"))
    return numbered.join(one, "__row", "left").select(*docs.columns, "__hit_runs", "__hit_items")


_BUILT: dict = {}


def _machine(key: str, group, window: int) -> Machine:
    """The group's automaton, built once a worker process; an earlier one is let go. The driver names the group, as an address
    may come back for another one's list."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Machine(group.value, window)
    return _BUILT[key]


def _ddl(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]


def op6(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text", "hit_spans")


#: Windows of both sides as strings of ten words; a document word is hit if a window that covers it is among the items'.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM p
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), m AS (SELECT dw.doc_id, dw.i, dw.n, p.item_id FROM dw JOIN p ON dw.s = p.s AND dw.n = p.n
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

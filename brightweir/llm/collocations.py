"""Phrases whose words occur together more often than apart, by language.

Texts are cut into pieces at punctuation and pieces into words; n-grams of 1 to ``max_n`` words become rows (language, phrase,
n, count) and are summed by a hash aggregation, a slice of text being summed up before its rows leave the task. Three passes
keep the rows few without losing any, as a phrase that occurs ``min_count`` times holds no rarer part: the first counts words;
the second counts pairs of frequent words by 64-bit hashes, which says which pairs can be frequent; the third counts all
n-grams from 2 words on whose pairs can be. Whether a word or pair may be frequent is looked up in a bitmap of hashes, 16 bits
for each one and at most ``filter_bytes``; where several share a hash or bit, more rows are counted than need be, and the
exact counts of words and of the third pass decide. A bitmap too small for the corpus costs time, never a phrase.

Candidates are then cut at every place and meet the counts of both sides in joins, salted as a frequent word may stand in very
many candidates; scores are whole numbers from decimals. A candidate goes if a one-word extension is as frequent (a longer
phrase around it that is as frequent has such an extension within it, as a part is never rarer than the whole). A window ranks
what is left of each language, and Spark drops lower ranks before the rows meet.

Null texts count as empty, null languages as ``und``. Repeated rows count each. Empty tables give no rows. Words and phrases of
any length are kept whole. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightweir.llm.arrow import pieces
from brightweir.operators.audit import met
from brightweir.session import scratch, table

#: A word of its own for every mark at which pieces end; no word holds a full stop.
_MARKS, _END = r"[.,;:!?\x0A-\x0D]", "."
_COUNTS = "lang string, phrase string, n int, f long"


def bitmap(hashes: DataFrame, most_bytes: int) -> Broadcast:
    """Words of a bitmap with a bit for each h (long) of a table, merged by Spark; at most ``most_bytes`` come to the driver."""
    n_words = int(min(most_bytes // 8, max(1024, hashes.count() // 4)))
    at = F.pmod("h", F.lit(n_words * 64))
    found = hashes.select(F.floor(at / 64).alias("at"), F.expr(f"shiftleft(1L, CAST(pmod(h, {n_words * 64}) % 64 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(n_words, np.uint64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(words)


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = (h % np.int64(len(words) * 64)).view(np.uint64)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.view(np.uint64), b.view(np.uint64)
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class Slice:
    """Words of some texts of one language, one after another; numbers stand for words, and edge words for ends of pieces."""

    def __init__(self, texts: pa.Array):
        cut = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), _MARKS, f" {_END} ")
        flat = pc.ascii_split_whitespace(pc.binary_join_element_wise(cut, pa.scalar(_END), " ")).flatten()
        words = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        self.words: pa.Array = words.dictionary
        self.at = words.indices.to_numpy().astype(np.int64)
        self.edge = pc.index(self.words, _END).as_py()

    def hashes(self, lang: str) -> np.ndarray:
        """Of the different words, as xxhash64(lang, word) is in Spark."""
        seed = xxhash.xxh64_intdigest(lang, 42)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words)).view(np.int64)

    def pairs(self, lang: str, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of pairs of words that may be frequent, hashes of these pairs)."""
        h = self.hashes(lang)
        ok = may_hold(frequent, h)
        ok[self.edge] = False
        ok = ok[self.at]
        starts = np.flatnonzero(ok[:-1] & ok[1:])
        return starts, _pair_hash(h[self.at[starts]], h[self.at[starts + 1]])

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.at[first + k])) for k in range(n)], " ")


def _rows(lang: str, phrases: pa.Array, n: int, f: np.ndarray) -> pa.RecordBatch:
    k = len(phrases)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), k), phrases, pa.repeat(pa.scalar(n, pa.int32()), k), pa.array(f.astype(np.int64))], ["lang", "phrase", "n", "f"])


def _sliced(docs: DataFrame, of_slice, schema: str) -> DataFrame:
    """Rows of of_slice(lang, Slice) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _tables(batches):
            for lang in pc.unique(held["lang"]).to_pylist():
                texts = held.filter(pc.equal(held["lang"], lang))["text"].combine_chunks()
                yield from of_slice(lang, Slice(texts))

    narrow = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return narrow.mapInArrow(run, schema)


def _summed(docs: DataFrame, of_slice) -> DataFrame:
    return _sliced(docs, of_slice, _COUNTS).groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f"))


def _tables(batches: Iterator[pa.RecordBatch], most: int = 12 << 20) -> Iterator[pa.Table]:
    """Slices of about ``most`` bytes."""
    held, size = [], 0
    for whole in batches:
        for batch in pieces(whole, "text"):
            n = batch["text"].nbytes
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def _words_of(lang: str, s: Slice) -> Iterator[pa.RecordBatch]:
    f = np.bincount(s.at, minlength=len(s.words))
    f[s.edge] = 0
    some = np.flatnonzero(f)
    yield _rows(lang, s.words.take(pa.array(some)), 1, f[some])


def phrase_counts(docs: DataFrame, max_n: int = 5, min_count: int = 100, filter_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(all words with their counts; phrases of 1 to max_n words that occur min_count times at least), each (lang, phrase, n, f)."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "phrases")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    words = written("words", _summed(docs, _words_of))
    often = words.where(F.col("f") >= min_count)
    if max_n < 2:
        return words, often
    singles = bitmap(often.select(F.xxhash64("lang", "phrase").alias("h")), filter_bytes)

    def pairs_of(lang: str, s: Slice) -> Iterator[pa.RecordBatch]:
        h, f = np.unique(s.pairs(lang, singles.value)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(f.astype(np.int64))], ["h", "f"])

    pairs = written("pairs", _sliced(docs, pairs_of, "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("h"))
    doubles = bitmap(pairs, filter_bytes)

    def phrases_of(lang: str, s: Slice) -> Iterator[pa.RecordBatch]:
        starts, h = s.pairs(lang, singles.value)
        yield from _phrases(s, lang, starts[may_hold(doubles.value, h)], max_n)

    return words, often.unionByName(written("longer", _summed(docs, phrases_of).where(F.col("f") >= min_count)))


def _phrases(s: Slice, lang: str, pairs: np.ndarray, max_n: int) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of 2 words and more, all of whose pairs start at the places given."""
    paired = np.zeros(len(s.at) + max_n, bool)
    paired[pairs] = True
    starts, number = pairs, s.at[pairs]
    for n in range(2, max_n + 1):
        on = paired[starts + n - 2]
        starts, number = starts[on], number[on]
        if not len(starts):
            return
        _, first, number = np.unique(number * (len(s.words) + 1) + s.at[starts + n - 1], return_index=True, return_inverse=True)
        yield _rows(lang, s.phrases(starts[first], n), n, np.bincount(number, minlength=len(first)))


def collocations(docs: DataFrame, max_n: int = 5, min_count: int = 100, scale: int = 1000, top: int | None = 2000, filter_bytes: int = 32 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, frequency and bytes; all where None."""
    words, frequent = phrase_counts(docs, max_n, min_count, filter_bytes)
    total = words.groupBy("lang").agg(F.sum("f").alias("total"))
    candidates = frequent.where("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    counts = frequent.where(F.col("n") < max_n).select(F.struct("lang", "phrase").alias("key"), "f")

    w = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first, rest = F.array_join(F.slice(w, F.lit(1), F.col("k")), " "), F.array_join(F.slice(w, F.col("k") + 1, F.col("size")), " ")
    left = met(cuts.withColumn("rest", rest).withColumn("key", F.struct("lang", first.alias("phrase"))), counts.withColumnRenamed("f", "l"), "key").drop("key")
    both = met(left.withColumn("key", F.struct("lang", F.col("rest").alias("phrase"))), counts.withColumnRenamed("f", "r"), "key").drop("key", "rest")
    # one row for each of a bounded number of languages meets very many candidates
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    with_n = met(both, total, "lang").withColumn("above", whole("a") * whole("total") * F.lit(scale).cast("decimal(9,0)")).withColumn("below", whole("l") * whole("r"))
    cut = F.struct(F.expr("above DIV below").cast("long").alias("score"), "k", "l", "r", F.col("total").alias("n"))
    scored = with_n.groupBy("lang", "phrase", "a").agg(F.min(cut).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")

    inside = candidates.where("size > 2").select("lang", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("size") - 1), " "))).alias("phrase"), F.col("a").alias("f"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(inside.where("f IS NOT NULL"), (scored.lang == inside.lang) & (scored.phrase == inside.phrase) & (inside.f >= scored.a), "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("place", place)
    if top is not None:
        ranked = ranked.where(F.col("place") <= top)
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0
), g AS (
  SELECT lang, 1 AS k, array_to_string(w[i : i + 0], ' ') AS phrase, count(*) AS f FROM spots WHERE i + 0 <= len(w) GROUP BY ALL
  UNION ALL
  SELECT lang, 2 AS k, array_to_string(w[i : i + 1], ' ') AS phrase, count(*) AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL
  UNION ALL
  SELECT lang, 3 AS k, array_to_string(w[i : i + 2], ' ') AS phrase, count(*) AS f FROM spots WHERE i + 2 <= len(w) GROUP BY ALL
  UNION ALL
  SELECT lang, 4 AS k, array_to_string(w[i : i + 3], ' ') AS phrase, count(*) AS f FROM spots WHERE i + 3 <= len(w) GROUP BY ALL
  UNION ALL
  SELECT lang, 5 AS k, array_to_string(w[i : i + 4], ' ') AS phrase, count(*) AS f FROM spots WHERE i + 4 <= len(w) GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100
), at_cut AS (SELECT *, unnest(range(1, size)) AS j FROM c
), cuts AS (SELECT *, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : size], ' ') AS tail FROM at_cut
), s AS (
  SELECT cuts.lang, cuts.phrase, a, j, l.f AS l, r.f AS r, n, (1000 * CAST(a AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = head AND l.k = j JOIN g r ON r.lang = cuts.lang AND r.phrase = tail AND r.k = size - j JOIN total ON total.lang = cuts.lang
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_at AS (SELECT *, unnest(range(1, size)) AS i FROM c WHERE size > 2
), inner_len AS (SELECT *, unnest(range(2, size)) AS m FROM inner_at
), inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS around FROM inner_len WHERE i + m - 1 <= size GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE around IS NULL OR 100 * around < 100 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

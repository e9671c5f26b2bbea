"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``least`` (4/5) or more, as components.

*Sets.* Shingles as in ``simhash.shingle_hashes``, as sets of 64-bit hashes. Texts with equal sets are one node, named by a
128-bit hash of the set. A text without words has the empty set.

*Fingerprints.* Each set has a SimHash fingerprint by op8's votes, and op8's operator (buckets of bands, bit planes, carry-save
counters) links those at ``RADIUS`` or fewer differing bits. Sets with one fingerprint are linked with the first of them.

*Candidates.* No radius that can be searched holds all pairs of the similarity (at 0.8 about 10 of 64 bits differ, give or take
3), so what fingerprints don't join is searched on: ``BANDS`` bands of ``ROWS`` minima each (MinHash). Two sets of similarity s share a bucket with probability
1 - (1 - s ** ROWS) ** BANDS: at 0.8 about 7 pairs in a million are missed, above it fewer. Sizes that rule out the
similarity are dropped. Each member of a bucket is first compared with the bucket's ``LEADERS`` leaders, drawn anew for each
bucket, so that a member of a large group meets several. Then what is still outside its bucket's largest component is
compared with all members of other components, so that no link of a bucket is lost and a large group costs few pairs. These
pairs are thinned by parities: a set's 512 bits say of which of 512 residues it has an odd number of hashes; two sets
differ in as many elements as bits at least, so most pairs below the similarity are ruled out, and none at or above it.

*Check.* Every candidate, of fingerprints and of buckets alike, is checked with the sets themselves, in whole numbers.

Null texts count as empty. Null ids and repeated rows are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.llm.arrow import as_bytes, pieces
from brightweir.llm.simhash import components, near_links, one_of_each, shingle_hashes, text_key, votes
from brightweir.operators.audit import met
from brightweir.session import cut, swept

BANDS, ROWS, WORDS = 30, 5, 5
LEADERS = 2
#: Bits in which the fingerprints of a candidate pair differ at most.
RADIUS = 7
PARITY = 8  # words of 64 bits
#: Similarity as a fraction.
LEAST = (4, 5)
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WORDS), "<u8"))


def bucket_keys(own: np.ndarray) -> np.ndarray:
    """A hash for each band."""
    if not len(own):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, ((own[at : at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def parity(own: np.ndarray) -> np.ndarray:
    """For each of 512 residues whether the set has an odd number of hashes with it."""
    odd = np.bincount((own % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def few_enough(m: str, n: str):
    """Whether sets of sizes m and n, whose parities are in p0, p1, ... and q0, q1, ..., may have the similarity: at least
    4/5 of the union in common is at most (m + n) / 9 in but one of the two."""
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(PARITY)])
    a, b = LEAST
    return (a + b) * differ <= (b - a) * (F.col(m) + F.col(n))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted) have the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def with_buckets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, node, fp, n, parity, buckets): one row per row of docs; n is the size of the set, fp its fingerprint."""
    base = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                sets = [shingle_set(t) for t in as_bytes(part["text"])]
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                prints = votes(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.int64)
                keys = pa.array([bucket_keys(s) for s in sets], pa.list_(pa.int64()))
                odd = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
                cols = [part["id"], part["key"], pa.array(names, pa.binary()), pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), odd, keys]
                yield pa.RecordBatch.from_arrays(cols, ["id", "key", "node", "fp", "n", "parity", "buckets"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, key binary, node binary, fp long, n int, parity array<long>, buckets array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts (node, text): (node, shingles), the hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([shingle_set(t).tobytes() for t in as_bytes(part["text"])], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node binary, shingles binary")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [alike(*(np.frombuffer(x.as_buffer(), "<u8") for x in two)) for two in zip(batch["of_a"], batch["of_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def near_enough(m: str, n: str):
    """Whether sizes m and n allow the similarity."""
    return LEAST[1] * F.least(m, n) >= LEAST[0] * F.greatest(m, n)


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp, n): (a, b), enough to connect all whose fingerprints differ in ``RADIUS`` bits at most, less those of
    sizes that rule out the similarity."""
    first = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("of"), F.count(F.lit(1)).alias("many"))
    of = lambda x: first.select(F.col("fp").alias(x), F.col("of").alias(f"of_{x}"))
    apart = near_links(first.select("fp"), RADIUS).join(of("a"), "a").join(of("b"), "b")
    same = met(nodes.select("node", "fp", "n"), first.where("many > 1").select("fp", "of"), "fp").where("of.node <> node")
    pairs = apart.select("of_a", "of_b").unionByName(same.select(F.struct("node", "n").alias("of_a"), F.col("of").alias("of_b")))
    return pairs.where(near_enough("of_a.n", "of_b.n")).select(*ordered("of_a.node", "of_b.node"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, key (of the text), node, root (the same for all rows of a component)."""
    prints = cut(with_buckets(docs, id_col, text_col))
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("buckets").alias("buckets")).where("n > 0")
    small = cut(prints.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    close = swept(fingerprint_pairs(small))
    # A bucket's number has its band in it. Counting goes by fixed-width values alone, so tasks sum up hot buckets before the shuffle.
    dealt = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    rank = lambda k: F.xxhash64("bucket", "node", F.lit(k))
    crowded = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), *[F.min(rank(k)).alias(f"least{k}") for k in range(LEADERS)]).where("many > 1").drop("many")
    leads = functools.reduce(Column.__or__, [rank(k) == F.col(f"least{k}") for k in range(LEADERS)])
    dealt = swept(dealt.join(crowded, "bucket").select("node", "n", "bucket", leads.alias("leads")))
    wanted = dealt.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(small, "node").select("node", "key")
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).join(wanted, "key")
    sets = swept(shingle_sets(texts.select("node", "text")).dropDuplicates(["node"]))

    leaders = dealt.where("leads").select("bucket", F.col("node").alias("other"), F.col("n").alias("m"))
    tried = dealt.join(leaders, "bucket").where((F.col("node") != F.col("other")) & near_enough("n", "m")).select(*ordered("node", "other"))
    tried = tried.unionByName(close).distinct()
    links = swept(checked(tried, sets))
    placed = swept(dealt.join(components(links), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")))
    # What is not in a bucket's largest component yet is compared with all that is in another one.
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    odd = nodes.select("node", *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY)])
    mixed = swept(placed.join(largest, "bucket").join(odd, "node"))
    minor = mixed.where("root <> main").select("bucket", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("elsewhere"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(PARITY)])
    rest = mixed.join(minor, "bucket").where((F.col("root") != F.col("elsewhere")) & near_enough("n", "m") & few_enough("n", "m"))
    rest = rest.select(*ordered("node", "other")).distinct().join(tried, ["a", "b"], "left_anti")
    roots = components(links.unionByName(checked(rest, sets)))
    return prints.select("id", "key", "node").join(roots, "node", "left").select(F.col("id").alias(id_col), "key", "node", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: the smallest id, nulls last. Columns as they were."""
    return one_of_each(docs, near_copies(docs, id_col, text_col), id_col, text_col)

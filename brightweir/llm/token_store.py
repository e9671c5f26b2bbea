"""Token ids as raw binary shards with a minimal perfect hash index.

Documents are sorted by id into shards (edges depend on the data alone). A shard has two files: ``ids-N.bin``, the ids of
its documents one after another as little-endian unsigned integers (two bytes where the vocabulary allows, else four),
and ``ids-N.idx``. The index maps a document's key to its place: levels of bit arrays in which each key that is alone at
its hashed position sets a bit, the rank of that bit being the key's slot; a slot stores a 32-bit fingerprint of the key
and the number of its first document. A lookup is a few hashes, one comparison and one slice of the payload, whatever
the shard's size. Files are written under temporary names and moved when whole; a manifest then names the shards, their
key ranges and the number of ids before each.

Null texts count as empty and hold just the end id. Null ids come first and aren't in the index. Repeated ids are neighbours, ordered by text,
and share a slot that points at the first. An empty table gives a store without shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightweir.llm import shards
from brightweir.llm.arrow import pieces
from brightweir.llm.words_bpe import encoder
from brightweir.session import scratch



def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level sizes, bits of all levels, ranks at every 64 bits."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        while len(left):
            m = -(-2 * len(left) // 64) * 64
            at = (_mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.empty(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for some keys that were not there at building; others of these get any slot."""
        out, base = np.full(len(keys), -1, np.int64), 0
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.bits[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left = left[~hit]
            base += m
        return out


class ShardIndex:
    """keys: of the documents in order; the first ``nulls`` of them have none, and a zero in its place."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, first: np.ndarray, keys: np.ndarray, starts: np.ndarray, nulls: int = 0):
        self.hashed, self.prints, self.first, self.keys, self.starts, self.nulls = hashed, prints, first, keys, starts, nulls

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, nulls: int = 0) -> ShardIndex:
        distinct, first = np.unique(keys[nulls:], return_index=True)
        hashed = PerfectHash.build(distinct)
        at = hashed.slots(distinct)
        prints, order = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        prints[at] = (_mix(distinct, 1 << 20) >> np.uint64(32)).astype("<u4")
        order[at] = first + nulls
        return cls(hashed, prints, order, keys.astype("<i8"), np.r_[0, np.cumsum(counts)].astype("<i8"), nulls)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key, -1 where there is none."""
        at = self.hashed.slots(keys)
        found = at >= 0
        found[found] = self.prints[at[found]] == (_mix(keys[found], 1 << 20) >> np.uint64(32)).astype("<u4")
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.first[at[found]]
        found[found] = self.keys[out[found]] == keys[found]
        out[~found] = -1
        return out

    def documents(self) -> np.ndarray:
        """The number of every document, those with a key found through the index: repeats of a key follow the first."""
        n = np.arange(len(self.keys))
        own = self.keys[self.nulls :]
        if len(own):
            at = np.arange(len(own))
            since = at - np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], at, 0))
            n[self.nulls :] = self.lookup(own) + since
        return n

    def to_bytes(self) -> bytes:
        arrays = [self.hashed.bits, self.prints, self.first, self.keys, self.starts]
        head = json.dumps({"levels": self.hashed.sizes, "lengths": [len(a) for a in arrays], "nulls": self.nulls}).encode()
        return b"BWIX" + len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        if raw[:4] != b"BWIX":
            raise ValueError("not an index")
        n = int.from_bytes(raw[4:8], "little")
        head, at, arrays = json.loads(raw[8 : 8 + n]), 8 + n, []
        for kind, size in zip(("<u8", "<u4", "<u4", "<i8", "<i8"), head["lengths"], strict=True):
            a = np.frombuffer(raw, kind, size, at)
            arrays.append(a)
            at += a.nbytes
        return cls(PerfectHash(head["levels"], arrays[0]), *arrays[1:], head["nulls"])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> str:
    """Writes shards of about shard_bytes of text to the folder and returns the manifest's path."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    edges = shards.range_edges(base.select("key", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")), shard_bytes)
    dealt = base.withColumn("shard", shards.bin_of(F.col("key"), edges))
    ordered = dealt.repartitionById(len(edges) + 1, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (fs, root) = encoder(tokenizer), shards.filesystem(path)
        fs.create_dir(root, recursive=True)
        kind = f"<u{encode.width}"
        tail = np.array([end_id], kind)
        parts = (p for b in batches for p in pieces(b, "text", 4 << 20))
        part = next(parts, None)
        if part is None:
            return
        shard, keys, counts, nulls = part["shard"][0].as_py(), [], [], 0
        with shards.whole_file(fs, f"{root}/ids-{shard:06d}.bin") as out:
            while part is not None:
                keys.append(part["key"].fill_null(0).to_numpy())
                nulls += part["key"].null_count
                for ids in encode.encode(part["text"]):
                    out.write(ids.astype(kind).tobytes())
                    out.write(tail.tobytes())
                    counts.append(len(ids) + 1)
                part = next(parts, None)
        index = ShardIndex.build(np.concatenate(keys), np.array(counts), nulls)
        with shards.whole_file(fs, f"{root}/ids-{shard:06d}.idx") as out:
            out.write(index.to_bytes())
        row = (shard, len(counts), int(index.starts[-1]), encode.width, int(index.keys[0]), int(index.keys[-1]))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["shard", "n_docs", "n_ids", "width", "low", "high"])

    # Sorted here: a row a shard, and an orderBy would run the job twice, once to sample it.
    rows = sorted(ordered.mapInArrow(run, "shard int, n_docs long, n_ids long, width int, low long, high long").collect())
    before, lines = 0, []
    for r in rows:
        lines.append((*r, before))
        before += r.n_ids
    manifest = f"{path}/manifest"
    spark.createDataFrame(lines, "shard int, n_docs long, n_ids long, width int, low long, high long, start long").coalesce(1).write.json(manifest)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, n_docs long, n_ids long, width int, low long, high long, start long").json(f"{path}/manifest")


def _load(fs, root: str, shard: int, width: int) -> tuple[ShardIndex, np.ndarray]:
    index = ShardIndex.from_bytes(fs.open_input_file(f"{root}/ids-{shard:06d}.idx").read())
    return index, np.frombuffer(fs.open_input_file(f"{root}/ids-{shard:06d}.bin").read(), f"<u{width}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of the store, each found through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shards.filesystem(path)
        for batch in batches:
            for r in batch.to_pylist():
                index, ids = _load(fs, root, r["shard"], r["width"])
                n = index.documents()
                lo, hi = index.starts[n], index.starts[n + 1]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(lo, hi, strict=True)]
                keys = pa.array(index.keys, pa.int64(), mask=np.arange(len(index.keys)) < index.nulls)
                yield pa.RecordBatch.from_arrays([keys, pa.array(lo + r["start"]), pa.array(hi - lo), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    shards_ = read_manifest(spark, path)
    return shards_.repartition(max(1, min(shards_.count(), 4096))).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def fetch(keys: DataFrame, path: str, key_col: str) -> DataFrame:
    """(key, ids) for the keys that the store has: keyed access, one task a shard that is asked for."""
    spark = keys.sparkSession
    manifest = read_manifest(spark, path).orderBy("shard").collect()
    edges = [r.low for r in manifest[1:]]  # nulls are in the first shard, whose lower edge isn't asked for
    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    width = {i: (r.shard, r.width) for i, r in enumerate(manifest)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shards.filesystem(path)
        index, payload, at = None, None, None
        for batch in batches:
            place, ks = batch["place"].to_numpy(), batch["key"].to_numpy()
            for p in np.unique(place):
                if p != at and int(p) in width:
                    shard, w = width[int(p)]
                    index, at = ShardIndex.from_bytes(fs.open_input_file(f"{root}/ids-{shard:06d}.idx").read()), p
                    payload = fs.open_input_file(f"{root}/ids-{shard:06d}.bin")
                own = ks[place == p]
                n = index.lookup(own)
                rows = [(int(k), np.frombuffer(payload.read_at((b - a) * w, a * w), f"<u{w}").tolist()) for k, a, b in zip(own[n >= 0], index.starts[n[n >= 0]].tolist(), index.starts[n[n >= 0] + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.int64()))], ["key", "ids"])

    dealt = asked.withColumn("place", shards.bin_of(F.col("key"), edges)).repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(run, "key long, ids array<long>").withColumnRenamed("key", key_col)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes a store in the shared folder and reads it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_documents(spark, path).withColumnRenamed("key", "doc_id")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brightweir.session import table

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

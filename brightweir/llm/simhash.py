"""SimHash near-duplicates: fingerprints, bit-sliced comparison, connected components.

*Fingerprint.* ASCII letters in lower case, words between white space, shingles of ``shingle`` words joined by a space
with repeats (a shorter text is one shingle). Each shingle votes with the 64 bits of its XXH64 (seed 42); a bit is set
if over half of the votes set it. A text without words has fingerprint zero.

*Comparison.* Documents with equal fingerprints are one node. The 64 bits are cut into ``radius + m`` bands; two
fingerprints within the radius agree in m bands at least, so each is dealt to one bucket for every choice of m bands.
m follows the number of fingerprints, which keeps buckets near the size that the comparison handles best. A bucket's
fingerprints are stored as 64 vertical bit planes. A query is compared with 64 others per machine word: plane by plane,
mismatches are added to carry-save counters that saturate above the radius, and a block is abandoned once all of its
lanes have. Buckets above ``tile`` fingerprints are cut into tiles, and every pair of tiles is a task's work, so no
bucket has to fit in one task and no link is lost. A bucket yields the links of a spanning forest, not all pairs.

*Components.* Alternating large-star and small-star steps over the links, each cut in the shared folder.

Null and empty texts have fingerprint zero and link like any other. Null ids are kept as rows; a component's id is the
smallest id that is not null, or null if there is none. Repeated rows share a component. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightweir.llm.arrow import as_bytes, pieces
from brightweir.operators.audit import met
from brightweir.session import cut

SEED = 42
#: Buckets of fewer fingerprints are compared several at once, as a comparison has a cost of its own; what links across buckets is a link too.
SMALL = 512
FULL = np.uint64((1 << 64) - 1)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(flat, SEED)]
    digest, starts, at = xxhash.xxh64_intdigest, [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[shingle:], at]
    return [digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]


def votes(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs [edges[i], edges[i + 1]) of hashes."""
    n = np.diff(edges)
    out = np.zeros(len(n), np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = n > 0
    if some.any():
        sums = np.add.reduceat(bits, edges[:-1][some], axis=0, dtype=np.int64)
        won = (2 * sums > n[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(won, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp long): one row per row of docs."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                lists = [shingle_hashes(t, shingle) for t in as_bytes(part["text"])]
                edges = np.cumsum([0, *map(len, lists)])
                flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint64, edges[-1])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(votes(flat, edges).view(np.int64))], ["id", "fp"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, fp long")


def bands(radius: int, m: int) -> list[np.ndarray]:
    """Masks of every choice of m of radius + m bands."""
    edges = np.linspace(0, 64, radius + m + 1).astype(int)
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in itertools.combinations(each, m)]


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows, each with one bit of every fingerprint, packed into words; lanes past the end repeat nothing (zero)."""
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros(lanes, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) at ``radius`` differing bits or fewer."""
    width = max(1, int(radius).bit_length())
    shape = (len(queries), sliced.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]  # vertical binary counters
    over = np.zeros(shape, np.uint64)  # lanes that can't come back
    limit = [bool(radius >> k & 1) for k in range(width)]
    rows = np.arange(len(queries))
    for bit in range(64):
        ask = np.where(queries[rows] >> np.uint64(bit) & np.uint64(1), FULL, np.uint64(0))[:, None]
        carry = sliced[bit][None, :] ^ ask
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % 8 == 7 and bit >= 4 * radius:
            above, equal = np.zeros_like(over), np.full_like(over, FULL)
            for k in reversed(range(width)):
                if limit[k]:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            over |= above
            alive = (over != FULL).any(axis=1)
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if alive.sum() < 0.7 * len(alive):  # abandon the blocks that are out of reach
                rows, over, counters = rows[alive], over[alive], [c[alive] for c in counters]
    hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n]
    q, lane = np.nonzero(hit)
    return rows[q], lane


def _hooked(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest over the components that label names, and the labels after them."""
    kept_a, kept_b = [], []
    while len(a):
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        order = np.lexsort((lo, hi))
        order = order[lo[order] < hi[order]]
        # Each larger label is hung on the smallest that it meets, so that no circle can close.
        first = order[np.flatnonzero(np.r_[True, hi[order][1:] != hi[order][:-1]])] if len(order) else order
        kept_a.append(a[first])
        kept_b.append(b[first])
        up = np.arange(len(label))
        up[hi[first]] = lo[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    none = np.empty(0, np.int64)
    return np.concatenate(kept_a or [none]), np.concatenate(kept_b or [none]), label


def bucket_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within the radius: inside left, or between left and right."""
    both = left if right is None else np.concatenate([left, right])
    other, base = (left, 0) if right is None else (right, len(left))
    label, links, sliced = np.arange(len(both)), [], planes(other)
    step = max(1, (1 << 22) // (64 * max(1, sliced.shape[1])))
    for at in range(0, len(left), step):
        q, lane = within(left[at : at + step], sliced, len(other), radius)
        a, b = q + at, lane + base
        fresh = label[a] != label[b]
        a, b, label = _hooked(a[fresh], b[fresh], label)
        links += zip(both[a].tolist(), both[b].tolist(), strict=True)
    return links


def near_links(nodes: DataFrame, radius: int, tile: int = 16384, target: int = 1024) -> DataFrame:
    """nodes (fp long, distinct): (a, b) links between different fingerprints, enough to connect what is within the radius."""
    n = nodes.count()
    m = next((m for m in range(1, 5) if n / 2 ** (64 * m / (radius + m)) <= target), 4)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(np.uint64(x).astype(np.int64).item())) for x in bands(radius, m)])).alias("band", "key"))
    keyed = keyed.select("fp", "band", F.xxhash64("band", "key").alias("key"))
    crowded = keyed.groupBy("band", "key").count().where(F.col("count") > 1).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    # A tile of its own for most buckets; t * (t + 1) / 2 pairs of tiles for a crowded one, each row being in t of them.
    own = F.pmod(F.xxhash64("fp", "band"), F.col("tiles").cast("long")).cast("int")
    # Both sides are rows for each band, which Spark sizes as rows of nodes: left to itself it may send the larger one to the driver.
    dealt = keyed.join(crowded.hint("merge"), ["band", "key"]).withColumn("own", own)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("fp", "band", "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), (F.col("own") > F.col("with")).alias("second"))
    sorted_ = dealt.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "second", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        small: list[np.ndarray] = []

        def together() -> list[tuple[int, int]]:
            fps = np.unique(np.concatenate(small))
            small.clear()
            return bucket_links(fps, None, radius)

        def links(rows: np.ndarray) -> list[tuple[int, int]]:
            fps, second = rows[:, 0].view(np.uint64), rows[:, 5] == 1
            if rows[0, 3] == rows[0, 4]:
                if len(fps) >= SMALL:
                    return bucket_links(fps, None, radius)
                small.append(fps)
                return together() if len(small) >= SMALL // 2 or sum(map(len, small)) >= SMALL else []
            return bucket_links(fps[~second], fps[second], radius) if second.any() and not second.all() else []

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch[c].cast(pa.int64()).to_numpy() for c in ("fp", "band", "key", "lo", "hi", "second")], axis=1)
            if not len(rows):
                continue
            cutat = np.flatnonzero((rows[1:, 1:5] != rows[:-1, 1:5]).any(axis=1)) + 1
            groups = np.split(rows, cutat)
            if held and (held[-1][-1, 1:5] == rows[0, 1:5]).all():
                held.append(groups.pop(0))
            pairs = []
            if groups:
                if held:
                    pairs += links(np.concatenate(held))
                for g in groups[:-1]:
                    if len(g) > 1:
                        pairs += links(g)
                held = [groups[-1]]
            if pairs:
                yield out(pairs)
        if held:
            yield out(links(np.concatenate(held)))
        if small:
            yield out(together())

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long): (node, root), the smallest node that each can reach, for all nodes that have a link."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: neighbours above a node are hung on the smallest neighbour.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below a node, and the node, are hung on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = cut(hung)
        same = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def placed(prints: DataFrame, radius: int, salts: int = 16) -> DataFrame:
    """prints (id, fp, ...): (fp, root, component_id) of fingerprints with a link or several rows: their component and its smallest
    id. Only fingerprints with a link meet their component, each component in ``salts`` parts."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp").join(nodes, "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(ids.hint("merge"), ["root", "salt"]).select("fp", "root", "component_id", F.lit(True).alias("linked"))
    out = nodes.join(linked, "fp", "left").where("linked OR n > 1")
    return out.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hexadecimal digits), component_id."""
    prints = cut(with_fingerprint(docs, id_col, text_col, shingle))
    # A fingerprint may be that of very many rows; those of a single row without links are their own component.
    rows = met(prints.select("id", "fp"), placed(prints, radius).select("fp", "component_id", F.lit(True).alias("told")), "fp")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def text_key(text_col: str):
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows (id, key, node, root), one per row of docs: of each root the row of docs with the smallest id (nulls last), node
    and text key. Rows are told apart by id and text; of rows that are equal in both, one stays."""
    rows = rows.withColumnRenamed(id_col, "__id").groupBy("root", "__id", "node", F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("__id").isNull().alias("last"), "__id", "node", "__key")
    rows = cut(rows.select("root", "rows", order.alias("row")))
    # Only roots with several rows meet their rows, in parts.
    first = rows.groupBy("root").agg(F.min("row").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = met(rows, first, "root").select("row.__id", "row.__key", "rows", (F.col("chosen").isNull() | (F.col("row") == F.col("chosen"))).alias("stays"))
    gone = cut(told.where("NOT stays").select("__id", "__key"))
    keyed = docs.withColumn("__text_key", text_key(text_col))
    kept = keyed.join(gone, keyed[id_col].eqNullSafe(gone["__id"]) & (keyed["__text_key"] == gone["__key"]), "left_anti")
    if not told.where("stays AND rows > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__text_key"])
    return kept.drop("__text_key")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs for each component: the smallest id, nulls last. Columns as they were."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("key")).alias("row"), F.col(text_col).alias("text"))
    prints = cut(with_fingerprint(keyed, "row", "text", shingle))
    rows = met(prints.select("id", "fp"), placed(prints, radius).select("fp", "root"), "fp").select(F.col("id.id").alias(id_col), "id.key", F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, rows, id_col, text_col)


def op8(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    return near_duplicates(table(spark, sf_dir, "documents"))

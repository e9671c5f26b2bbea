"""Quality rules: counts of each text, and bands of n-gram perplexity for each language.

*Counts.* Words are runs between ASCII white space. See ``counts`` for what is counted; a text fails at once if it has
few words or if words of repeated three-word windows make up most of it.

*Model.* For each language a modified Kneser-Ney model of character 5-grams: code points in lower case, runs of white
space as one space, digits alike, ASCII punctuation as two kinds, code points from U+0800 on folded into 2,048 classes, so
that an n-gram fits in 60 bits. The n-grams that are gathered grow with the corpus. Tasks count their own; sorted keys and counts go to buckets by (language, third and
fourth symbol). All that the orders 5 to 3 need of an n-gram meets in its bucket: its extensions to the left, and all that
follows its contexts. Only the tables of pairs and of counts of counts are summed up for a language; pairs are bounded by
the alphabet. A bucket of the model is a set of sorted hash arrays (n-grams of orders 5 to 3 with log-probabilities,
contexts with back-off weights), which scoring searches for the distinct n-grams of a batch.

*Scoring.* Buckets are sent to tasks in groups of at most ``GROUP_BYTES``, a group a pass over the texts, and a text's sum
grows by those n-grams whose bucket is there. One group is enough for some gigabytes of text; from the second on, passes are
jobs of their own, so that one group at a time is held.

*Bands.* Per-character log-perplexities of all texts that pass the counts give a histogram for each language; a text is
rejected above the upper quartile plus ``reach``, or below the lower one minus ``reach_below``, times their distance.
The defaults are chosen on the labelled rows of sf0.1: about one in a hundred rows of quality 1 may be rejected.

Null texts have no words. Null languages are a language of their own (with the value ``und``). Repeated rows get equal
results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightweir.llm.arrow import appended, pieces
from brightweir.session import cut

ORDER, BITS = 5, 12
#: Distinct n-grams of a language that a task holds before it passes them on.
HELD = 3_000_000
GROUP_BYTES = 64 << 20
#: Bins of log-perplexity for 1.
FINE = 1000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(b"#*$%&|<>")] = True
_SPACE_BYTES = np.zeros(256, bool)
_SPACE_BYTES[list(b" \t\n\x0b\x0c\r")] = True


def _symbols() -> np.ndarray:
    """Symbol of each code point below U+0800, and of the classes above."""
    out = np.arange(1 << BITS, dtype=np.int64)
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = ord("." if chr(c) in ".,;:!?" else "#")
    out[48:58] = 48
    return out


_SYMBOL = _symbols()
_SPACES = np.array([ord(c) for c in "\t\n\x0b\x0c\r \x85\xa0"], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """Codes of the n-grams that end at each symbol, the latest symbol lowest; the text begins after blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(points < 0x800, points, 0x800 + (points * np.uint32(2654435761) >> np.uint32(21)))
    s[np.isin(points, _SPACES)] = 32
    s = _SYMBOL[s]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    s = np.r_[np.full(ORDER - 1, 32, np.int64), s[keep]]
    n = len(s) - ORDER + 1
    code = s[:n].copy()
    for k in range(1, ORDER):
        code = code << BITS | s[k : k + n]
    return code


def shorter(code: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols of a code."""
    return code & ((1 << BITS * n) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def hashed(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of codes of n symbols; different for different n and codes, as mixing loses nothing."""
    return _mixed(code.astype(np.uint64) | np.uint64(n) << np.uint64(61))


def bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    """By the third and fourth of five symbols, the end of every context."""
    return (_mixed(code >> BITS & ((1 << 2 * BITS) - 1)) >> np.uint64(40)).astype(np.int64) % buckets


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (words in three-word windows that the text has twice or more)."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(_SPACE_BYTES[raw].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, int(_SYMBOL_BYTES[raw].sum()), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    if n < 2_000_000:
        code = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
        code = pair * n + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(code)] |= twice
    return int(hit.sum())


def _packed(x: np.ndarray) -> bytes:
    """Sorted or small numbers, as bytes of equal weight together."""
    x = np.ascontiguousarray(x.astype("<i8"))
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").ravel()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _by_language(part: pa.RecordBatch) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a slice: the rows that have symbols, all their codes, and where each row's begin."""
    rows: dict[str, list[tuple[int, np.ndarray]]] = {}
    for i, (lang, text) in enumerate(zip(part["lang"].to_pylist(), pc.fill_null(part["text"], "").to_pylist(), strict=True)):
        if text:
            rows.setdefault(lang, []).append((i, ngrams(text)))
    return {k: (np.array([i for i, _ in v]), np.concatenate([c for _, c in v]), np.cumsum([0, *(len(c) for _, c in v)])[:-1]) for k, v in rows.items()}


class _Tally:
    """Sorted n-grams and their counts of one language in one task."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, codes: np.ndarray) -> None:
        keys, n = np.unique(codes, return_counts=True)
        self.parts.append((keys, n))
        self.n += len(keys)
        if self.n > HELD and len(self.parts) > 1:
            self.parts = [self.all()]
            self.n = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = zip(*self.parts, strict=True)
        return _summed(np.concatenate(keys), np.concatenate(n))


def count_ngrams(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (lang, text): (lang, bucket, keys, n) over all texts; a row a task, language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, n = tallies.pop(lang).all()
            at = bucket_of(keys, buckets)
            rows = [(lang, b, _packed(np.diff(keys[at == b], prepend=0)), _packed(n[at == b])) for b in np.unique(at).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "bucket", "keys", "n"])

        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                for lang, (_, codes, _) in _by_language(part).items():
                    if lang not in tallies and len(tallies) >= 8:
                        yield out(next(iter(tallies)))
                    own = tallies.setdefault(lang, _Tally())
                    own.add(codes)
                    if own.n > HELD:
                        yield out(lang)
        for lang in list(tallies):
            yield out(lang)

    return docs.mapInArrow(run, "lang string, bucket int, keys binary, n binary")


def merge_counts(counted: DataFrame) -> DataFrame:
    """One row a (lang, bucket): keys and n; spread, the counts of counts 1 to 4 of the orders 5, 4 and 3; pairs with n_pairs,
    how many different symbols precede a pair here."""

    def run(group: pa.Table) -> pa.Table:
        keys, n = _summed(np.concatenate([np.cumsum(_unpacked(b)) for b in group["keys"].to_pylist()]), np.concatenate([_unpacked(b) for b in group["n"].to_pylist()]))
        spread, kept, c = [], keys, n
        for order in (5, 4, 3):
            spread += [int((c == k).sum()) for k in range(1, 5)]
            kept, c = np.unique(shorter(kept, order - 1), return_counts=True)
        row = {"lang": group["lang"][:1], "bucket": group["bucket"][:1]}
        packed = {"keys": np.diff(keys, prepend=0), "n": n, "spread": np.array(spread), "pairs": np.diff(kept, prepend=0), "n_pairs": c}
        return pa.table(row | {k: pa.array([_packed(v)], pa.binary()) for k, v in packed.items()})

    return counted.groupBy("lang", "bucket").applyInArrow(run, "lang string, bucket int, keys binary, n binary, spread binary, pairs binary, n_pairs binary")


def heads(merged: DataFrame) -> DataFrame:
    """One row a language: spread, pairs and n_pairs of all its buckets. Pairs are bounded by the alphabet's square."""

    def run(group: pa.Table) -> pa.Table:
        spread = sum(_unpacked(b) for b in group["spread"].to_pylist())
        pairs, n = _summed(np.concatenate([np.cumsum(_unpacked(b)) for b in group["pairs"].to_pylist()]), np.concatenate([_unpacked(b) for b in group["n_pairs"].to_pylist()]))
        return pa.table({"lang": group["lang"][:1]} | {k: pa.array([_packed(v)], pa.binary()) for k, v in (("all_spread", spread), ("all_pairs", np.diff(pairs, prepend=0)), ("all_n", n))})

    return merged.select("lang", "spread", "pairs", "n_pairs").groupBy("lang").applyInArrow(run, "lang string, all_spread binary, all_pairs binary, all_n binary")


def discounts(n: list[int]) -> np.ndarray:
    """What to take off counts of 0, 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    if not all(n):
        return np.array([0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0, *(min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3))])


class _Order:
    """One order's n-grams: interpolated probabilities, and totals and reserved mass of the contexts."""

    def __init__(self, keys: np.ndarray, c: np.ndarray, off: np.ndarray, below: np.ndarray):
        """below: probability of the shorter n-gram, for each key."""
        self.keys = keys
        self.contexts, at = np.unique(keys >> BITS, return_inverse=True)
        taken = off[np.minimum(c, 3)]
        self.total, self.mass = np.bincount(at, c, len(self.contexts)), np.bincount(at, taken, len(self.contexts))
        self.p = (c - taken + self.mass[at] * below) / self.total[at]


def kneser_ney(keys: np.ndarray, n: np.ndarray, spread: np.ndarray, pairs: np.ndarray, n_pairs: np.ndarray) -> dict[str, np.ndarray]:
    """A bucket of the model from its 5-grams and its language's head: sorted hashes of n-grams of orders 5 to 1 with natural
    log-probabilities, and of contexts with back-off weights."""
    ones, c1 = np.unique(shorter(pairs, 1), return_counts=True)
    of = lambda c: discounts([int((c == k).sum()) for k in range(1, 5)])
    orders = {1: _Order(ones, c1, of(c1), np.full(len(ones), 1 / (len(ones) + 1)))}
    orders[2] = _Order(pairs, n_pairs, of(n_pairs), orders[1].p[np.searchsorted(ones, shorter(pairs, 1))])
    grams = {5: (keys, n)}
    for k in (4, 3):
        grams[k] = np.unique(shorter(grams[k + 1][0], k), return_counts=True)
    for k in (3, 4, 5):
        own, c = grams[k]
        orders[k] = _Order(own, c, discounts(spread[4 * (5 - k) : 4 * (5 - k) + 4].tolist()), orders[k - 1].p[np.searchsorted(orders[k - 1].keys, shorter(own, k - 1))])
    hashes = np.concatenate([hashed(orders[k].keys, k) for k in range(1, 6)])
    probs = np.log(np.maximum(np.concatenate([orders[k].p for k in range(1, 6)]), 1e-12))
    by = np.argsort(hashes)
    contexts = np.concatenate([hashed(orders[k].contexts, k - 1) for k in range(2, 6)])
    weights = np.log(np.maximum(np.concatenate([orders[k].mass / orders[k].total for k in range(2, 6)]), 1e-12))
    by_context = np.argsort(contexts)
    return {"keys": hashes[by], "probs": probs[by].astype(np.float32), "contexts": contexts[by_context], "weights": weights[by_context].astype(np.float32)}


_MODEL = {"keys": np.uint64, "probs": np.float32, "contexts": np.uint64, "weights": np.float32}


def look_up(codes: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log-probabilities of 5-grams: their own, or back-off weights down to the longest n-gram that the model has."""

    def find(h: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
        return at, sorted_[at] == h

    out, left = np.full(len(codes), -12 * np.log(10)), np.arange(len(codes))
    weight = np.zeros(len(codes))
    for k in range(5, 0, -1):
        at, hit = find(hashed(shorter(codes[left], k), k), model["keys"])
        out[left[hit]] = weight[hit] + model["probs"][at[hit]]
        left, weight = left[~hit], weight[~hit]
        if k > 1:
            at, hit = find(hashed(shorter(codes[left], k) >> BITS, k - 1), model["contexts"])
            weight = weight + np.where(hit, model["weights"][at], 0)
    return out


def fit(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (lang, text): (lang, bucket, and the four arrays of the model as bytes, size)."""
    merged = cut(merge_counts(count_ngrams(docs, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                made = kneser_ney(np.cumsum(_unpacked(r["keys"])), _unpacked(r["n"]), _unpacked(r["all_spread"]), np.cumsum(_unpacked(r["all_pairs"])), _unpacked(r["all_n"]))
                cols = [pa.array([r["lang"]], pa.string()), pa.array([r["bucket"]], pa.int32()), *(pa.array([made[k].tobytes()], pa.binary()) for k in _MODEL), pa.array([sum(a.nbytes for a in made.values())], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "bucket", *_MODEL, "size"])

    joined = merged.select("lang", "bucket", "keys", "n").join(heads(merged), "lang").repartition("lang", "bucket")
    return joined.mapInArrow(run, "lang string, bucket int, " + ", ".join(f"{k} binary" for k in _MODEL) + ", size long")


def groups(sizes: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int]]]:
    """(language, bucket, bytes) in groups of at most ``most`` bytes, or of a single bucket."""
    out, held = [], most + 1
    for lang, bucket, size in sorted(sizes):
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append((lang, bucket))
        held += size
    return out


def scored(docs: DataFrame, models: DataFrame, buckets: int, most: int = GROUP_BYTES) -> DataFrame:
    """docs (lang, text, ...) without text, with the five counts and nll, the mean natural log of the inverse probability of a
    symbol (0 for no symbols)."""
    spark = docs.sparkSession
    each = groups([tuple(r) for r in models.select("lang", "bucket", "size").collect()], most) or [[]]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def passed(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables: dict[tuple[str, int], dict] = {}
            own: dict[str, list[int]] = {}
            for lang, bucket in shared.value:
                own.setdefault(lang, []).append(bucket)
            for batch in batches:
                for part in pieces(batch, "text", 4 << 20):
                    total = np.zeros(part.num_rows) if first else part["nll"].to_numpy(zero_copy_only=False).copy()
                    size = np.zeros(part.num_rows, np.int64)
                    for lang, (rows, codes, starts) in _by_language(part).items():
                        size[rows] = np.diff(np.r_[starts, len(codes)])
                        if lang not in own:
                            continue
                        distinct, back = np.unique(codes, return_inverse=True)
                        value, at = np.zeros(len(distinct)), bucket_of(distinct, buckets)
                        for b in own[lang]:
                            if (lang, b) not in tables:
                                tables[lang, b] = {k: np.frombuffer(x, kind) for x, (k, kind) in zip(shared.value[lang, b], _MODEL.items(), strict=True)}
                            here = at == b
                            value[here] = look_up(distinct[here], tables[lang, b])
                        total[rows] -= np.add.reduceat(value[back], starts)
                    if not first:
                        part = part.drop_columns(["nll"])
                    made = {"nll": pa.array(total / np.maximum(size, 1) if last else total)}
                    if first:
                        done = [counts(t or b"") for t in part["text"].cast(pa.binary()).to_pylist()]
                        made = {c: pa.array([d[i] for d in done], pa.int64()) for i, c in enumerate(_COUNTS)} | made
                    yield appended(part, **made) if not last else appended(part, **made).drop_columns(["text"])

        return run

    out = docs
    for i, some in enumerate(each):
        first, last = i == 0, i == len(each) - 1
        wanted = spark.createDataFrame(some, "lang string, bucket int") if len(each) > 1 else None
        rows = (models.join(F.broadcast(wanted), ["lang", "bucket"]) if wanted else models).collect()  # a group, of bounded size
        shared = spark.sparkContext.broadcast({(r.lang, r.bucket): tuple(bytes(r[k]) for k in _MODEL) for r in rows})
        cols = [c for c in kept if not (last and c.startswith("`text`"))] + [f"{c} long" for c in _COUNTS] + ["nll double"]
        out = out.mapInArrow(passed(shared, first, last), ", ".join(cols))
        if not last:
            out = cut(out)
            shared.unpersist()
    return out


def bands(scored: DataFrame, reach: float, reach_below: float) -> DataFrame:
    """scored (lang, nll): (lang, lowest, highest), from a histogram of all rows."""
    bins = scored.groupBy("lang", F.floor(F.col("nll") * FINE).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")
    bins = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    per = bins.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    wide = F.col("q3") - F.col("q1") + 1
    return per.select("lang", ((F.col("q1") - reach_below * wide) / FINE).alias("lowest"), ((F.col("q3") + 1 + reach * wide) / FINE).alias("highest"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, reach: float = 2.0, reach_below: float = 2.5) -> DataFrame:
    """One row per row of docs: id, the five counts, base_failed, kept, perplexity (natural, per symbol)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-total // (1 << 30)))  # a bucket is what a task merges of a language
    models = cut(fit(base.select("lang", "text"), buckets))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(scored(base, models, buckets).withColumn("base_failed", failed))
    limits = cut(bands(rows.where("NOT base_failed"), reach, reach_below))
    out = rows.join(limits, "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("nll").between(F.col("lowest"), F.col("highest")), F.lit(False))
    return out.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", kept.alias("kept"), F.exp("nll").alias("perplexity"))


def op3(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    return quality(table(spark, sf_dir, "documents"))

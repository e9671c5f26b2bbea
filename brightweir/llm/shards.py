"""Sorted shards with edges that depend on the data alone, and files that appear whole or not at all."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.session import cut

LOW, HIGH = -(1 << 63), (1 << 63) - 1


#: Shards that a store has at most, or about so: from then on shards grow instead.
MOST = 20_000


def range_edges(keys: DataFrame, target: int, start: int = 64) -> list[int]:
    """keys (key long, size long): sorted lower edges of all shards but the first, each shard of about target bytes, or of the
    total's part in ``MOST`` if that is more, so that what the driver holds doesn't grow with the data.

    Bins of equal width are counted, and those above the target are cut finer, until each is small or a single key. What
    comes to the driver is a sum for each bin, some bins a shard. Equal data give equal edges in any run."""
    keys = cut(keys.where("key IS NOT NULL").select("key", "size"))
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if low is None or not total or total <= target:
        return []
    target = max(target, -(-total // MOST))
    edges = sorted({low + (high + 1 - low) * i // start for i in range(start)})
    for _ in range(70):
        sums = dict(keys.groupBy(bin_of(F.col("key"), edges).alias("bin")).agg(F.sum("size")).collect())
        finer, ends = set(edges), [*edges[1:], high + 1]
        for i, (lo, hi) in enumerate(zip(edges, ends, strict=True)):
            if (held := sums.get(i + 1, 0)) > target // 4 and hi - lo > 1:
                parts = min(hi - lo, 4 * -(-held // target), 4096)
                finer |= {lo + (hi - lo) * j // parts for j in range(parts)}
        if len(finer) == len(edges) or max(sums.values()) <= target // 4:
            break
        edges = sorted(finer)
    shards, held = [], 0
    for i, lo in enumerate(edges):
        own = sums.get(i + 1, 0)
        if held and held + own > target:
            shards.append(lo)
            held = 0
        held += own
    return shards


def bin_of(key: Column, edges: list[int]) -> Column:
    """How many edges are at or below the key; 0 for null."""
    if not edges:
        return F.lit(0)
    at = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return F.when(key.isNull(), F.lit(0)).otherwise(run(F.coalesce(key, F.lit(LOW))))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@contextlib.contextmanager
def whole_file(fs: pafs.FileSystem, path: str) -> Iterator:
    """A stream to a temporary name beside the path, moved to the path at the end. A repeated attempt writes the same."""
    head, _, name = path.rpartition("/")
    temporary = f"{head}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        yield out
    fs.move(temporary, path)

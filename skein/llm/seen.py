"""Has this key been seen before? A sharded quotient filter over all earlier keys.

A key's 64-bit hash gives a fingerprint: the quotient (its leading bits, whose foremost ones number the shard) and
the remainder. A shard stores, for each quotient, how many remainders it has (the runs) and the remainders in
order, two bytes each with the default of 16 bits. Partial filters are built where the keys lie; they are sparse, sorted
fingerprints of a shard as differences, so that many small ones cost no more than their keys. They are merged in pairs
per shard, and only the merged filter has runs; it is the same as one built at once. A key that is not in the filter has
certainly not been seen. Of those that are, an exact check of the candidates tells the wrong ones, which gives the measured
rate; earlier keys go there only if a bitmap of the candidates has them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import host_folded_id
from skein.runtime import stage

FILTER_SCHEMA = "shard int, runs binary, remainders binary"
PARTIAL_SCHEMA = "shard int, prints binary"
KEYS_PER_SHARD = 500_000
PARTIAL_KEYS = 4_000_000  # keys of a partial filter, which is what a task holds
MAP_BITS = 29  # the bitmap of the candidates has at most 2^29 bits, 64 MB; it helps up to that many candidates


class Layout:
    """Bits of a filter for about ``n`` keys: shard and quotient together have as many values as fit at a load of 3/4."""

    def __init__(self, n: int, remainder_bits: int = 16):
        self.quotient_bits = max(10, math.ceil(math.log2(max(n, 1) / 0.75)))
        self.remainder_bits = remainder_bits
        self.shard_bits = min(self.quotient_bits - 4, max(6, math.ceil(math.log2(max(n, 1) / KEYS_PER_SHARD))))
        if self.quotient_bits + remainder_bits > 63 or remainder_bits not in (8, 16, 32):
            raise ValueError("remainder_bits must be 8, 16 or 32 and fit into the hash")

    @property
    def kind(self):
        return {8: np.uint8, 16: np.uint16, 32: np.uint32}[self.remainder_bits]

    def fingerprint(self, hashed):
        """Column: the leading quotient and remainder bits of a 64-bit hash, as a long that is not negative."""
        return F.shiftrightunsigned(hashed, 64 - self.quotient_bits - self.remainder_bits)

    def shard(self, fingerprint):
        return F.shiftright(fingerprint, self.quotient_bits - self.shard_bits + self.remainder_bits).cast("int")

    def pack(self, prints: np.ndarray) -> tuple[bytes, bytes]:
        """Runs and remainders of sorted distinct fingerprints of one shard."""
        within = self.quotient_bits - self.shard_bits
        quotient = (prints >> self.remainder_bits) & ((1 << within) - 1)
        runs = np.bincount(quotient, minlength=1 << within)
        wide = next(k for k in (np.uint8, np.uint16, np.uint32) if runs.max() <= np.iinfo(k).max)
        head = np.array([np.dtype(wide).itemsize], np.uint8).tobytes()
        return head + runs.astype(wide).tobytes(), (prints & ((1 << self.remainder_bits) - 1)).astype(self.kind).tobytes()

    def unpack(self, shard: int, runs: bytes, remainders: bytes) -> np.ndarray:
        """The sorted fingerprints that ``pack`` stored."""
        counts = np.frombuffer(runs, {1: np.uint8, 2: np.uint16, 4: np.uint32}[runs[0]], offset=1).astype(np.int64)
        within = self.quotient_bits - self.shard_bits
        quotient = np.repeat(np.arange(len(counts), dtype=np.int64), counts) + (shard << within)
        return (quotient << self.remainder_bits) | np.frombuffer(remainders, self.kind).astype(np.int64)

    def split(self, prints: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The shards of fingerprints in any order, and of each shard its sorted distinct ones as differences of the least width."""
        prints = np.unique(prints)
        shards = prints >> (self.quotient_bits - self.shard_bits + self.remainder_bits)
        at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(prints) else np.empty(0, np.int64)
        within = prints & ((1 << (self.quotient_bits - self.shard_bits + self.remainder_bits)) - 1)
        steps = np.diff(within, prepend=0)
        steps[at] = within[at]
        parts = np.split(steps, at[1:]) if len(at) else []
        kinds = [next(k for k in (np.uint16, np.uint32, np.uint64) if p.max() <= np.iinfo(k).max) for p in parts]
        return shards[at], [bytes([np.dtype(k).itemsize]) + p.astype(k).tobytes() for k, p in zip(kinds, parts)]

    def join(self, shard: int, prints: bytes) -> np.ndarray:
        """The sorted fingerprints of one part that ``split`` made."""
        steps = np.frombuffer(prints, {2: np.uint16, 4: np.uint32, 8: np.uint64}[prints[0]], offset=1)
        return np.cumsum(steps.astype(np.int64)) + (shard << (self.quotient_bits - self.shard_bits + self.remainder_bits))


class Merger:
    """Sorted distinct fingerprints of one shard, from parts that come one after another: two of about one size are merged into one, so that each is merged a logarithmic number of times."""

    def __init__(self):
        self.held: list[np.ndarray] = []

    def add(self, part: np.ndarray) -> None:
        self.held.append(part)
        while len(self.held) > 1 and len(self.held[-2]) <= 2 * len(self.held[-1]):
            right, left = self.held.pop(), self.held.pop()
            self.held.append(np.union1d(left, right))

    def all(self) -> np.ndarray:
        whole = self.held.pop() if self.held else np.empty(0, np.int64)
        while self.held:
            whole = np.union1d(self.held.pop(), whole)
        return whole


def build_filter(prints: DataFrame, layout: Layout) -> DataFrame:
    """(shard, runs, remainders) over a column fp of fingerprints. Each task makes sparse partial filters per shard; they are merged as they come in."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            shards, parts = layout.split(np.concatenate(held))
            held.clear()
            return pa.record_batch({"shard": pa.array(shards, pa.int32()), "prints": pa.array(parts, pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= PARTIAL_KEYS:
                yield close()
        if held:
            yield close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, merger = None, Merger()

        def close() -> pa.RecordBatch:
            runs, remainders = layout.pack(merger.all())
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "runs": pa.array([runs], pa.binary()), "remainders": pa.array([remainders], pa.binary())})

        for batch in batches:
            for of, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard is not None and of != shard:
                    yield close()
                shard = of
                merger.add(layout.join(of, prints))
        if shard is not None:
            yield close()

    partials = prints.select("fp").mapInArrow(partial, PARTIAL_SCHEMA)
    return partials.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, FILTER_SCHEMA)


def cut_by_bitmap(keys: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """The rows of ``keys`` whose fp may be one of ``wanted``: all that are, and about one in eight of the others or less.

    The bitmap has eight bits for each wanted fingerprint, 2^MAP_BITS at most, and is broadcast in pieces of 4 KB; where
    there are so many that it would be full, all keys are returned.
    """
    bits = min(MAP_BITS, max(15, math.ceil(math.log2(max(n_wanted, 1) * 8))))
    if n_wanted > 1 << MAP_BITS:
        return keys
    place = F.shiftrightunsigned(F.xxhash64("fp"), 64 - bits)
    piece, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))
    maps = wanted.select(piece.alias("piece"), bit.alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit.bitwiseAND(F.lit(7)) + 1).cast("int"))) > 0
    return keys.withColumn("piece", piece).join(F.broadcast(maps), "piece").filter(is_set).select(*keys.columns)


def _local_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows whose key has a smaller row_id in the same batch, so that a hot key leaves a batch once."""
    for batch in batches:
        coded = batch.column(1).dictionary_encode().indices.to_numpy()
        row_ids = batch.column(0).to_numpy()
        least = np.full(coded.max() + 1 if len(coded) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, coded, row_ids)
        yield batch.append_column("repeated", pa.array(row_ids > least[coded]))


def _probe(layout: Layout):
    def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["row_id"].to_numpy(), rows["fp"].to_numpy()))
        prints, row_ids = rows["fp"].to_numpy()[order], rows["row_id"].to_numpy()[order]
        # equal fingerprints: a row is a candidate if an earlier row has its fingerprint
        new = np.ones(len(prints), bool)
        new[1:] = prints[1:] != prints[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(prints)), 0)) if len(prints) else np.empty(0, int)
        candidate = row_ids > row_ids[start]
        for shard, runs, remainders in zip(held["shard"], held["runs"], held["remainders"]):
            known = layout.unpack(int(shard), runs, remainders)
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            candidate |= known[at] == prints
        return pd.DataFrame({"row_id": row_ids[candidate]})

    return probe


def seen_before(rows: DataFrame, earlier: DataFrame, remainder_bits: int = 16) -> DataFrame:
    """(row_id, wrong) of each row whose fingerprint was in the filter; wrong tells that its key had not been seen.

    ``rows`` is (row_id, url), ``earlier`` has url. A row has been seen if its id, host in lower case and scheme left
    out, is in ``earlier`` or in a row of smaller row_id. Null addresses are never seen and fill no filter; two rows
    of one row_id do not count as earlier than each other. Empty tables give no rows.
    """
    keys = earlier.select(host_folded_id(F.col("url")).alias("key")).filter("key is not null")
    marked = stage(
        rows.select(F.col("row_id").cast("long").alias("row_id"), host_folded_id(F.col("url")).alias("key")).filter("key is not null")
        .mapInArrow(_local_firsts, "row_id long, key string, repeated boolean"),
        "keys",
    )
    layout = Layout(earlier.count() + marked.count(), remainder_bits)
    hashed = F.xxhash64("key")
    fp = layout.fingerprint(hashed)
    held = build_filter(keys.select(fp.alias("fp")), layout)
    firsts = marked.filter("not repeated").select("row_id", "key", fp.alias("fp"))
    probes = firsts.select("row_id", "fp", layout.shard(F.col("fp")).alias("shard"))
    candidates = stage(probes.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(_probe(layout), "row_id long"), "candidates")
    # the exact check, of candidates only: earlier keys that share a fingerprint with one of them
    open_ = stage(firsts.join(candidates.hint("merge"), "row_id"), "open")
    wanted = stage(open_.select("fp").distinct(), "wanted")
    near = cut_by_bitmap(keys.select("key", fp.alias("fp"), F.lit(None).cast("long").alias("row_id")).unionByName(firsts), wanted, wanted.count())
    before = near.join(wanted, "fp")  # not a semi join, which the optimizer would push below the bitmap
    known = before.groupBy("key").agg(F.count(F.when(F.col("row_id").isNull(), 1)).alias("n_earlier"), F.min("row_id").alias("first_id"))
    checked = open_.join(known, "key").select("row_id", ((F.col("n_earlier") == 0) & (F.col("row_id") <= F.col("first_id"))).alias("wrong"))
    return marked.filter("repeated").select("row_id", F.lit(False).alias("wrong")).union(checked)


def error_rates(checked: DataFrame, n_rows: int, n_keys: int, remainder_bits: int = 16) -> DataFrame:
    """One row: rows, candidates, wrong answers, their measured rate among the rows not seen, and the rate derived from the bits."""
    layout = Layout(n_keys, remainder_bits)
    load = n_keys / 2**layout.quotient_bits
    return checked.agg(
        F.lit(n_rows).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count(F.when(F.col("wrong"), 1)).alias("n_wrong"),
    ).select(
        "n_rows", "n_candidates", "n_wrong",
        (F.col("n_wrong") / F.greatest(F.lit(1), F.col("n_rows") - F.col("n_candidates") + F.col("n_wrong"))).alias("measured_rate"),
        F.lit(1 - math.exp(-load * 2.0**-remainder_bits)).alias("derived_rate"),
    )

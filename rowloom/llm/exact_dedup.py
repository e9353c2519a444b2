"""Exact duplicates through counting quotient filters.

Each task builds one filter per slice (the leading bits of the 64-bit fingerprint) of what it has read: the
fingerprint's quotient gives a home slot, its remainder is stored in a sorted run, with a count. Filters of a slice
merge without loss by walking their sorted remainders. Fingerprints counted more than once go to a byte
verification, which groups the normalised texts themselves; only then do rows become one group.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays (null ids are
smaller than all others, and of repeated rows with one id a single row stays); an empty table gives an empty
result. A fingerprint and SHA-256 digest that two different texts share stop the job instead of merging them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, fresh, passing, scratch, shuffle_width

SLICE_BITS_MAX = 12
SALTS = 16  # tasks over which the copies of one text are dealt


class QuotientFilter:
    """Counting quotient filter over fingerprints of one slice; `low_bits` are left of them below the slice's bits.

    Slots are in order of (quotient, remainder); `occupied` says which quotients have a run, `ends` which slot ends one.
    """

    def __init__(self, low_bits: int, values: np.ndarray, counts: np.ndarray):
        """values: sorted, distinct, below 2**low_bits."""
        self.low_bits = low_bits
        self.q_bits = max(1, int(np.ceil(np.log2(max(2, 1.35 * len(values))))))
        self.r_bits = low_bits - self.q_bits
        quotient = (values >> np.uint64(self.r_bits)).astype(np.int64)
        self.remainders = values & np.uint64((1 << self.r_bits) - 1)
        self.counts = counts.astype(np.int64)
        n = len(values)
        order = np.arange(n)
        self.slots = np.maximum.accumulate(quotient - order) + order if n else order  # each in its home or the next free slot
        self.occupied = np.zeros(1 << self.q_bits, bool)
        self.occupied[quotient] = True
        self.ends = np.append(quotient[1:] != quotient[:-1], True)[:n] if n else np.zeros(0, bool)

    @classmethod
    def build(cls, low_bits: int, values: np.ndarray) -> QuotientFilter:
        return cls(low_bits, *np.unique(values, return_counts=True))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts, sorted: the k-th run belongs to the k-th occupied quotient."""
        run = np.cumsum(self.ends) - self.ends
        quotient = np.flatnonzero(self.occupied)[run] if len(run) else run
        return (quotient.astype(np.uint64) << np.uint64(self.r_bits)) | self.remainders, self.counts

    def count(self, value: int) -> int:
        quotient, remainder = value >> self.r_bits, value & ((1 << self.r_bits) - 1)
        if not self.occupied[quotient]:
            return 0
        rank = int(self.occupied[:quotient].sum())
        stops = np.flatnonzero(self.ends)
        a, b = (stops[rank - 1] + 1 if rank else 0), stops[rank] + 1
        at = a + np.searchsorted(self.remainders[a:b], np.uint64(remainder))
        return int(self.counts[at]) if at < b and self.remainders[at] == remainder else 0

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        (a, m), (b, n) = self.items(), other.items()
        values = np.concatenate([a, b])
        order = np.argsort(values, kind="stable")  # a merge of two sorted runs
        values, counts = values[order], np.concatenate([m, n])[order]
        first = np.append(True, values[1:] != values[:-1])[: len(values)]
        return QuotientFilter(self.low_bits, values[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(values) else counts)

    def dump(self) -> bytes:
        width = (self.r_bits + 7) // 8
        head = np.array([self.low_bits, self.q_bits, len(self.counts)], "<i8").tobytes()
        body = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        many = np.flatnonzero(self.counts > 1)  # counts of one are not stored
        tail = np.array([len(many)], "<i8").tobytes() + many.astype("<i8").tobytes() + self.counts[many].astype("<i8").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.ends).tobytes() + body + tail

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        low_bits, q_bits, n = np.frombuffer(data, "<i8", 3).tolist()
        at, width, quotients = 24, (low_bits - q_bits + 7) // 8, 1 << q_bits
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, (quotients + 7) // 8, at), count=quotients).astype(bool)
        at += (quotients + 7) // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        (k,) = np.frombuffer(data, "<i8", 1, at).tolist()
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(data, "<i8", k, at + 8)] = np.frombuffer(data, "<i8", k, at + 8 + 8 * k)
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(occupied)[run] if n else run
        values = (quotient.astype(np.uint64) << np.uint64(low_bits - q_bits)) | wide.view("<u8")[:, 0]
        return cls(low_bits, values, counts)


def normalise(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """The fingerprints (a bigint column) that occur more than once, each in one row."""
    bits = min(SLICE_BITS_MAX, max(1, (shuffle_width(prints.sparkSession) - 1).bit_length()))
    low = 64 - bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        filters: dict[int, QuotientFilter] = {}

        def flush() -> None:
            values = np.sort(np.concatenate(held))
            held.clear()
            slices = values >> np.uint64(low)
            starts = np.flatnonzero(np.append(True, slices[1:] != slices[:-1])[: len(slices)])
            for part in np.split(values, starts[1:]):
                if len(part):
                    own = QuotientFilter.build(low, part & np.uint64((1 << low) - 1))
                    key = int(part[0] >> np.uint64(low))
                    filters[key] = filters[key].merge(own) if key in filters else own

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) > 1_000_000:
                flush()
        if held:
            flush()
        for key, own in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([own.dump()], pa.binary())], ["slice", "filter"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        filters = [QuotientFilter.load(x) for x in parts["filter"]]
        while len(filters) > 1:  # pairwise, so that each value moves a few times only
            filters = [a.merge(*b) if b else a for a, *b in (filters[i : i + 2] for i in range(0, len(filters), 2))]
        values, counts = filters[0].items()
        full = (values[counts > 1] | np.uint64(int(key[0]) << low)).view(np.int64)
        return pd.DataFrame({"fp": full})

    built = prints.select(column).mapInArrow(build, "slice int, filter binary")
    return built.groupBy("slice").applyInPandas(merge, "fp bigint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept and text_sha256 of the normalised text.

    Texts travel only where their fingerprint repeats, and one copy of a text per task: copies are
    counted before the shuffle, so a group of any size makes no hot task.
    """
    norm = normalise(F.col(f"`{text_col}`"))
    thin = scratch(
        docs.select(
            F.col(f"`{id_col}`").alias("id"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-thin",
    )
    repeated = scratch(repeated_fingerprints(thin), "exact-repeated")
    groups = (
        thin.groupBy("fp", "sha")
        .agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("size"))
        .join(repeated, "fp", "left_semi")
    )
    spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = (
        docs.select(norm.alias("norm"), F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(SALTS)).cast("int").alias("salt"))
        .withColumn("fp", F.xxhash64("norm"))
        .join(spread.hint("shuffle_hash"), ["fp", "salt"], "left_semi")
        .groupBy("fp", "norm")
        .agg(F.lit(1).alias("one"))
    )
    verified = texts.groupBy("fp", F.sha2("norm", 256).alias("sha")).agg(F.count("*").alias("texts"))
    classes = groups.join(verified, ["fp", "sha"]).withColumn(
        "size", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint"))
    )
    spread = classes.select("fp", "sha", "keep", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = thin.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    return dealt.join(spread, ["fp", "sha", "salt"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("size").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies, columns unchanged. Rows that share id and text stay once."""
    sha, own, same = (fresh(docs, n) for n in ("_sha", "_id", "_kept"))
    with passing() as keep:
        groups = exact_groups(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias(own), "group_size", "kept", F.col("text_sha256").alias(same))
        groups = scratch(groups, "exact-groups")
        keep.append(groups)
    tagged = docs.withColumn(sha, F.sha2(normalise(F.col(f"`{text_col}`")), 256))
    kept = groups.filter("kept").select(own, same)
    once = tagged.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.col(sha) == F.col(same)), "left_semi")
    if not groups.filter("group_size > 1").groupBy(own, same).count().filter("count > 1").isEmpty():  # only these can be repeated rows
        once = once.dropDuplicates([id_col, sha])
    return once.drop(sha)

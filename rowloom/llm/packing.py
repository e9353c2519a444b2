"""Packing of token pieces into sequences by exact-complement hashing, then best fit.

Only the number of pieces of each length matters for the plan, at most `capacity` numbers whatever the input. From the
longest length down, the gap that a piece leaves is looked up among single lengths, pair sums and triple sums that
are still available, and as many whole combinations as the counts allow are consumed at once; there is one plan, in which all three take part. What is
left is placed by best fit, decreasing, for all sequences with the same gap together. The plan maps ranges of ranks within
a length to sequences; pieces get their ranks from counts per (length, bucket), so no length makes a hot task.

Defined results: a null text is empty and makes one piece of the end id alone; an empty table gives an empty result;
equal rows become pieces of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, scratch, shuffle_width, small_batches

CAPACITY = 1024
END_ID = 2
BATCH_IDS = 1 << 18  # ids that a task gives back at once


# --- the plan -----------------------------------------------------------------------------------------------------


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences), using each length exactly as often as counts say.

    From the longest length down, its gap is filled by a single length, then by pair sums, then by triple sums, the most even
    ones first, since small lengths fill what best fit leaves open. Of every length one piece is spared from pairs and triples, so that
    best fit finds all lengths.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    made: list[tuple[tuple[int, ...], int]] = []

    def consume(longest: int, rest: tuple[int, ...], spared: int) -> None:
        pattern = (longest, *rest)
        n = int(min((have[x] - (spared if x in rest else 0)) // pattern.count(x) for x in set(pattern)))
        if n > 0:
            for x in pattern:
                have[x] -= n
            made.append((pattern, n))

    def pairs(total: int, largest: int) -> list[int]:
        """The larger halves x of available pairs (x, total - x), the most even first."""
        x = np.arange((total + 1) // 2, min(largest, total - 1) + 1)
        return x[(have[x] > 1) & (have[total - x] > np.where(2 * x == total, 2, 1))].tolist()

    consume(capacity, (), 0)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if have[a] and gap <= a:
            consume(a, (gap,), 0)
        if have[a] and gap <= 2 * a:
            for x in pairs(gap, a):
                consume(a, (x, gap - x), 1)
                if not have[a]:
                    break
        if have[a] and gap <= 3 * a:
            for b in np.flatnonzero(have[: min(a, gap - 2) + 1] > 1).tolist():
                if 3 * b < gap:
                    continue
                for x in pairs(gap - b, b):
                    consume(a, (b, x, gap - b - x), 1)
                    if not have[a] or have[b] < 2:
                        break
                if not have[a]:
                    break
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by gap
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            gap = min((g for g, bins in open_bins.items() if g >= length and bins), default=None)
            if gap is None:
                per = capacity // length
                full, rest = divmod(left, per)
                for k, n in ((per, full), (rest, 1)):
                    if k and n:
                        open_bins[capacity - k * length][(length,) * k] += n
                left = 0
            else:
                pattern, n = next(iter(open_bins[gap].items()))
                put = min(left, n)
                open_bins[gap][pattern] -= put
                if not open_bins[gap][pattern]:
                    del open_bins[gap][pattern]
                open_bins[gap - length][(*pattern, length)] += put
                left -= put
    return made + [(p, n) for bins in open_bins.values() for p, n in bins.items()]


def plan_rows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset); a few per length and pattern."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, n in plan_patterns(counts, capacity):
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + n, base, offset))
            used[length] += n
            offset += length
        base += n
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), buckets: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset added (or replaced). Lengths must be from 1 to capacity.

    A piece of full length is a sequence of its own, with a negative number, and is neither ranked nor shuffled. What is
    broadcast is bounded whatever the input: the plan has a few rows for each length and pattern, and the counts
    have `capacity` times `buckets` rows at most (buckets follow the shuffle partitions, from 64 to 256).
    """
    spark = pieces.sparkSession
    buckets = buckets or min(256, max(64, shuffle_width(spark)))
    bucket, serial, rank, n, before, at = (fresh(pieces, x) for x in ("_bucket", "_serial", "_rank", "_n", "_before", "_at"))
    len_, own, from_, to, base, offset = (fresh(pieces, x) for x in ("_len", "_own", "_from", "_to", "_base", "_offset"))
    size = F.col(f"`{length}`")
    hashed = F.pmod(F.xxhash64(*[f"`{c}`" for c in order]), F.lit(buckets)).cast("int")
    tagged = scratch(pieces.withColumns({bucket: hashed, serial: F.monotonically_increasing_id()}), "pack-pieces")
    per_bucket = scratch(tagged.groupBy(size.alias(len_), F.col(bucket).alias(own)).agg(F.count("*").alias(n)), "pack-counts")
    counts = {r[0]: r[1] for r in per_bucket.groupBy(len_).agg(F.sum(n)).collect()}  # at most `capacity` rows
    if bad := [x for x in counts if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"lengths must be from 1 to {capacity}: {bad[:5]}")
    counts.pop(capacity, None)
    keep = [F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    full = tagged.filter(size == capacity).select(*keep, (-1 - F.col(serial)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    earlier = F.sum(n).over(Window.partitionBy(len_).orderBy(own)) - F.col(n)
    starts = per_bucket.filter(F.col(len_) < capacity).select(len_, own, earlier.alias(before))
    ranks = F.row_number().over(Window.partitionBy(size, bucket).orderBy(*[f"`{c}`" for c in order])) - 1
    ranked = tagged.filter(size < capacity).withColumn(rank, ranks.cast("long"))
    ranked = ranked.join(F.broadcast(starts), (size == F.col(len_)) & (F.col(bucket) == F.col(own))).drop(len_)
    plan = spark.createDataFrame(plan_rows(counts, capacity), f"{len_} int, {from_} long, {to} long, {base} long, {offset} long")
    placed = ranked.withColumn(at, F.col(rank) + F.col(before)).join(
        F.broadcast(plan), (size == F.col(len_)) & (F.col(at) >= F.col(from_)) & (F.col(at) < F.col(to))
    )
    return placed.select(*keep, (F.col(base) + F.col(at) - F.col(from_)).alias("sequence_id"), F.col(offset).alias("offset")).unionByName(full)


# --- tokens -------------------------------------------------------------------------------------------------------


class _Tokenizer:
    """Ids of whole texts as the library tokenizers gives them with the same file: texts with a special string by that library, which is
    loaded only when such a text comes, the rest, which has the same ids, by the faster tiktoken over the file's own vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        from .byte_bpe import load_ranks, special_tokens

        self.path, self.special = path, special_tokens(path)
        ranks = {t: i for t, i in load_ranks(path).items() if i not in self.special.values()}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        """Straight into an array, without a list of ints."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> _Tokenizer:
    return _Tokenizer(path, pattern)


def tokenize_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of each document, end id included: doc_id, piece, start, length and
    ids (little-endian unsigned 32-bit). Only the first piece of a document may be shorter than the others. A worker holds
    one text and its ids, and about BATCH_IDS ids of pieces."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            rows, piece, start, length, ids, held = [], [], [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    [id_col, "piece", "start", "length", "ids"],
                )

            for i in range(batch.num_rows):
                own = np.append(tokenizer.ids(batch.column(1)[i].as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                cuts = range(len(own) % capacity or capacity, len(own) + 1, capacity)
                for k, b in enumerate(cuts):
                    a = max(0, b - capacity)
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(own[a:b].tobytes())
                    held += b - a
                    if held >= BATCH_IDS:
                        yield made()
                        rows, piece, start, length, ids, held = [], [], [], [], [], 0
            if rows:
                yield made()

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)


def read_sequences(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in order, from placed pieces that still have their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

A document's set is its distinct shingles of `size` lower-cased words. Equal sets become one class first. Of each class HASHES
MinHash samples are cut into BANDS keys and folded into an odd sketch, a bitmap in which each sample flips one bit; the XOR
of two sketches has about n/2 * (1 - exp(-4k(1 - J)/n)) bits set, which tells high similarities J apart. Classes with a
common band key are candidates; what the sketches put surely below the threshold is dropped, the rest is confirmed on
the full sets, which hold a keyed 64-bit hash of each shingle; the key is drawn anew for each run, so texts can't be made up to
meet in it. A pair at the threshold 0.8 meets in a band but for 1.2e-7, and passes the sketches but for about 1e-6 (by a normal approximation).

Candidates are taken so that no group of copies becomes all its pairs: first each class with one hub, then with a hub of each
of its buckets that it isn't connected to yet, and at last all pairs of a bucket that are still unconnected, compared in
blocks in memory, each pair in its first common band only. A pair whose ends are connected already can't
change a component, so none is lost by skipping it.

Defined results: a null text, and one without words, has an empty set and is linked with nothing; a text of fewer words than
a shingle has one shingle of them all; a row with a null id takes no part, its component is null and it is kept; rows that share
id and text get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, passing, scratch, small_batches
from ._words import Words, draw_key, mix, run_hashes

SHINGLE = 5
THRESHOLD = 80  # per cent
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
MARGIN = 0.16  # of similarity, about five standard deviations of the sketches' estimate
PAIRS = 1 << 14  # likely pairs of a block that are looked at from lists at once
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21  # classes of a bucket, or shingles, that are compared with as many others at once

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes | None], size: int, key: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words = Words(texts, lower=True)
    hashes = words.hashes(key)
    whole = run_hashes(hashes, words.runs(size), size) if len(hashes) >= size else hashes[:0]
    used = 0
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(whole[used : used + b - a - size + 1])
            used += b - a - size + 1
        else:
            yield run_hashes(hashes[a:b], np.zeros(1, np.int64), b - a) if b > a else hashes[:0]


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart, whatever their order."""
    n = np.uint64(len(shingles))
    return np.array([shingles.sum(dtype=np.uint64) + n, mix(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], "<u8").tobytes()


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES samples of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        part = (x[a : a + 4096, None] ^ _FLIP) * _FACTOR
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix(key + rows[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities as SKETCH_WORDS 64-bit numbers."""
    at = (mix(samples.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(at, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimate(popcount: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the population count of the XOR of two sketches."""
    return 1 + SKETCH_BITS / (4 * HASHES) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(popcount, float) / SKETCH_BITS))


def most_bits(threshold: int) -> int:
    """The largest population count at which a pair is still a candidate."""
    least = threshold / 100 - MARGIN
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * HASHES * (1 - least) / SKETCH_BITS)))


def confirmed(a: bytes, b: bytes, threshold: int) -> bool:
    """100 * intersection >= threshold * union, of sets stored as sorted 64-bit numbers."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _texts(batches: Iterator[pa.RecordBatch], column: int, size: int = 64) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, part.column(column).cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str, key: int) -> DataFrame:
    """id, n, cls, bands and odd of each row; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            n, cls, bands, odd = [], [], [], []
            for own in shingle_sets(texts, size, key):
                samples = minhashes(own) if len(own) else None
                n.append(len(own))
                cls.append(None if samples is None else class_key(own))
                bands.append(None if samples is None else band_keys(samples))
                odd.append(None if samples is None else odd_sketch(samples))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, longs), pa.array(odd, longs)], ["id", "n", "cls", "bands", "odd"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "id bigint, n bigint, cls binary, bands array<bigint>, odd array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable, of all nodes of the edges (columns a, b). Labels spread to neighbours and jump
    to their label's label, so the rounds grow with the logarithm of a component's width."""
    both = scratch(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "near-edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "near-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("other"))
        spread = scratch(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("comp")), "near-spread")
        onward = spread.select(F.col("node").alias("comp"), F.col("comp").alias("onward"))
        jumped = spread.join(onward, "comp", "left").select("node", "old", F.least("comp", F.coalesce("onward", "comp")).alias("comp"))
        labels = scratch(jumped, "near-labels")
        if labels.filter("old <> comp").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable) and kept."""
    small_batches(docs.sparkSession)
    with passing() as keep:
        signed, by_class = _found(docs, id_col, text_col, size, threshold)
        keep += [signed, by_class]
    found = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return signed.select("id", "n", "cls").join(by_class, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept")
    )


def _found(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the class of their set, and of each class the smallest id that it is connected to."""
    key = draw_key()
    signed = scratch(signatures(docs, size, id_col, text_col, key), "near-signatures")
    usable = signed.filter("id is not null and cls is not null")
    classes = usable.groupBy("cls").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = scratch(classes.withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    member = classes.select("rep", "n", F.explode("bands").alias("key"))
    draw = F.struct(F.xxhash64("rep", "key").alias("h"), F.col("rep").alias("rep"))
    shared = member.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("rep").alias("hub"), F.min(draw).alias("draw")).filter("m > 1")
    # What is joined to rows of a hot key is written first: AQE splits skewed partitions only of joins between plain shuffles.
    shared = scratch(shared.select("key", "m", "weight", "hub", F.col("draw.rep").alias("drawn")), "near-shared")
    active = scratch(member.drop("n").join(shared, "key"), "near-active")
    reps = scratch(
        classes.join(active.select("rep").distinct(), "rep").select("rep", "first", "cls", "odd", "bands"), "near-reps"
    )  # the classes that share a bucket at all
    sets = _full_sets(docs, reps, size, id_col, text_col, key)

    comp = reps.select("rep", F.col("rep").alias("comp"))
    first = active.groupBy("rep").agg(F.min("hub").alias("hub")).filter("hub < rep").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    comp = _connect(comp, _links(first, reps, sets, threshold))

    to = comp.select(F.col("rep").alias("drawn"), F.col("comp").alias("to"))
    second = active.join(comp, "rep").join(to, "drawn").filter("comp <> to").select(F.greatest("rep", "drawn").alias("a"), F.least("rep", "drawn").alias("b")).distinct()
    comp = _connect(comp, _links(second, reps, sets, threshold))

    open_keys = active.join(comp, "rep").groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c <> d").select("key")
    rest = active.filter("m > 2").join(scratch(open_keys, "near-open"), "key", "left_semi").select("key", "m", "weight", "rep")
    rest = rest.join(comp, "rep").join(reps.select("rep", "odd", "bands"), "rep").join(sets, "rep")
    comp = _connect(comp, _open_links(rest, threshold))

    named = comp.join(reps.select("rep", "first", "cls"), "rep")
    smallest = scratch(named.groupBy("comp").agg(F.min("first").alias("component_id")), "near-smallest")
    by_class = classes.select("cls", "first").join(named.join(smallest, "comp").select("cls", "component_id"), "cls", "left")
    by_class = scratch(by_class.select("cls", F.coalesce("component_id", "first").alias("found")), "near-found")
    return signed, by_class


def _full_sets(docs: DataFrame, reps: DataFrame, size: int, id_col: str, text_col: str, key: int) -> DataFrame:
    """rep and its whole set, of the classes that share a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 2):
            cls = part.column(1).to_pylist()
            got = [(i, own) for i, own in enumerate(shingle_sets(texts, size, key)) if len(own) and class_key(own) == cls[i]]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.array([own.astype("<u8").tobytes() for _, own in got], pa.binary())], ["rep", "shingles"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("first"), F.col(f"`{text_col}`").cast("string").alias("t"))
    own = rows.join(reps.select("rep", "first", "cls").hint("shuffle_hash"), "first").select("rep", "cls", "t")
    found = scratch(own.mapInArrow(run, "rep bigint, shingles binary"), "near-sets")
    if found.count() > reps.count():  # repeated rows
        found = found.groupBy("rep").agg(F.first("shingles").alias("shingles"))
    return found


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the sketches don't rule out and the full sets confirm."""
    odd = reps.select("rep", "odd")
    near = pairs.join(odd.toDF("a", "odd_a"), "a").join(odd.toDF("b", "odd_b"), "b")
    bits = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = near.filter(bits <= most_bits(threshold)).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            yes = pa.array([confirmed(x[i].as_py(), y[i].as_py(), threshold) for i in range(batch.num_rows)], pa.bool_())
            yield batch.select(["a", "b"]).filter(yes)

    full = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return scratch(full.mapInArrow(run, "a bigint, b bigint"), "near-links")


def _connect(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rep, comp) after the links are added."""
    to = comp.select(F.col("rep").alias("b"), F.col("comp").alias("to"))
    edges = links.join(comp, links["a"] == comp["rep"]).join(to, "b").filter("comp <> to").select(F.col("comp").alias("a"), F.col("to").alias("b"))
    edges = scratch(edges.distinct(), "near-contracted")
    if edges.isEmpty():
        return comp
    merged = components(edges).toDF("comp", "new")
    return scratch(comp.join(merged, "comp", "left").select("rep", F.coalesce("new", "comp").alias("comp")), "near-comp")


def _open_links(rest: DataFrame, threshold: int) -> DataFrame:
    """Links between classes of a bucket that are in different components, enough to connect all that are linked. A bucket of
    any size is compared block by block, in memory; the likeliest pairs come first, since what they connect
    needs no further look."""
    most = most_bits(threshold)
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rows = rest.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    rows = rows.select("key", "low", "high", "own", "rep", "comp", "odd", "bands", "shingles")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        number, low, high = key
        own = group["own"].to_numpy()
        rep, comp, sets = group["rep"].to_numpy(), group["comp"].to_numpy(), group["shingles"].tolist()
        odd, bands = np.array(group["odd"].tolist(), np.int64).view(np.uint64), np.array(group["bands"].tolist(), np.int64)
        band = int(np.flatnonzero((bands == number).all(axis=0))[0])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        likely: list[tuple[np.ndarray, ...]] = []
        for i in left if len(right) else []:
            js = right[(comp[right] != comp[i]) & ((rep[right] < rep[i]) if low == high else True)]
            bits = np.bitwise_count(odd[js] ^ odd[i]).sum(axis=1)
            js, bits = js[bits <= most], bits[bits <= most]
            if band and len(js):  # pairs are looked at in their first common band
                new = ~(bands[js, :band] == bands[i, :band]).any(axis=1)
                js, bits = js[new], bits[new]
            if len(js):
                likely.append((bits.astype(np.int16), np.full(len(js), i, np.int32), js.astype(np.int32)))
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (above := up.get(c, c)) != c:
                up[c] = c = up.get(above, above)
            return c

        out = []
        if likely:
            bits, i_all, j_all = (np.concatenate(x) for x in zip(*likely))
            likely.clear()
            order = np.argsort(bits, kind="stable")
            for at in range(0, len(order), PAIRS):  # a block may have a million pairs, too many for lists of numbers
                some = order[at : at + PAIRS]
                for i, j in zip(i_all[some].tolist(), j_all[some].tolist()):
                    a, b = root(int(comp[i])), root(int(comp[j]))
                    if a != b and confirmed(sets[i], sets[j], threshold):
                        up[max(a, b)] = min(a, b)
                        out.append((int(max(rep[i], rep[j])), int(min(rep[i], rep[j]))))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return scratch(rows.groupBy("key", "low", "high").applyInPandas(compare, "a bigint, b bigint"), "near-links")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs without all but the smallest id of each component, columns unchanged. Rows without an id stay."""
    name = fresh(docs, "_gone")
    gone = near_groups(docs, id_col, text_col, size, threshold).filter("not kept").select(F.col(f"`{id_col}`").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")

"""Removal of word passages that an earlier document has, with a count-min prefilter.

A window is `window` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller id.

1. Tasks cut their documents into blocks. Of each block a sparse count-min sketch of its windows is made, cut into
   slices by hash.
2. Slices of all blocks are merged by adding cells. A cell counts at least as often as each of its windows, so windows
   with a cell below two are unique; for all others the block gets back one bit.
3. Blocks send only the windows estimated repeated, each once with the smallest id that has it in the block, to an exact
   grouping by two independent keyed 64-bit hashes (the keys are drawn anew for each run, so texts can't be made up to
   meet in them); back comes one bit: whether a smaller id has it elsewhere.
4. Blocks drop the covered words.

No window is lost by the sketch, whatever its size. A passage in any number of documents is one entry per block. Slices are as many as
the texts' bytes ask for, so a slice's work doesn't grow with the input.

Defined results: null and short texts have no windows; a null id neither removes nor loses words; equal ids do not
remove each other's words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import scratch, small_batches
from ._words import Words, draw_key, run_hashes

WINDOW = 50
BLOCK_BYTES = 4_000_000
DEPTH, CELL_BITS = 2, 22  # rows of the sketch, and cells of a row in one slice
SLICE_BYTES = 10_000_000  # of text whose windows share a slice; at words of six bytes 2.5 cells for each
Keys = tuple[int, int]


class Block:
    """Documents of a block with the hashes of their windows."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes | None], window: int, keys: Keys, cell_bits: int = CELL_BITS):
        """known: which ids are not null; documents without one have no windows here."""
        self.ids, self.known, self.window, self.cell_bits = ids, known, window, cell_bits
        self.words = Words(texts)
        at = self.words.runs(window)
        owner = self.words.owner()[at]
        at, owner = at[known[owner]], owner[known[owner]]
        self.at, self.doc = at, ids[owner]
        self.h1, self.h2 = (run_hashes(self.words.hashes(key), at, window) if len(at) else np.zeros(0, np.uint64) for key in keys)

    def cells(self, row: int, slices: int) -> np.ndarray:
        """slice << cell_bits | cell of each window in a row of the sketch."""
        part = (self.h1 >> np.uint64(1)) % np.uint64(slices)
        cell = (self.h1 if row == 0 else self.h2 + np.uint64(row) * self.h1) >> np.uint64(64 - self.cell_bits)
        return (part << np.uint64(self.cell_bits)) | cell

    def sketch(self, row: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted cells and their counts, which stop at two."""
        cells, counts = np.unique(self.cells(row, slices), return_counts=True)
        return cells, np.minimum(counts, 2).astype(np.uint8)

    def estimated_repeated(self, masks: dict[tuple[int, int], bytes], slices: int) -> np.ndarray:
        """For each window whether its cells count two or more in all rows."""
        out = np.ones(len(self.at), bool)
        for row in range(DEPTH):
            cells = self.cells(row, slices)
            known, where = np.unique(cells, return_inverse=True)
            hot = _unmask(known >> np.uint64(self.cell_bits), masks, row)
            out &= hot[where]
        return out

    def entries(self, wanted: np.ndarray, slices: int) -> tuple[np.ndarray, ...]:
        """Distinct windows among the wanted, in order of slice and hash: slice, h1, h2, smallest id, and of each wanted window its number."""
        part, h1, h2, doc = ((self.h1 >> np.uint64(1)) % np.uint64(slices))[wanted], self.h1[wanted], self.h2[wanted], self.doc[wanted]
        order = np.lexsort((doc, h2, h1, part))
        part, h1, h2, doc = part[order], h1[order], h2[order], doc[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return part[new], h1[new], h2[new], doc[new], number


def _unmask(part: np.ndarray, masks: dict[tuple[int, int], bytes], row: int) -> np.ndarray:
    """Bits that came back for entries whose slices are `part` (sorted); a slice without any has no row."""
    out = np.zeros(len(part), bool)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    for a, b in zip(starts, [*starts[1:], len(part)]):
        if (bits := masks.get((row, int(part[a])))) is not None:
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned values byte plane by byte plane, compressed: high planes of small gaps are zeros."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :width] = raw.T
    return wide.view("<u8")[:, 0].astype(np.uint64)


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


Docs = tuple[np.ndarray, np.ndarray, list[bytes | None]]  # ids, which of them are known, texts


def _pack(ids: np.ndarray, known: np.ndarray, texts: list[bytes | None]) -> bytes:
    lengths = np.array([-1 if t is None else len(t) for t in texts], "<i8")
    head = np.array([len(texts)], "<i8").tobytes() + ids.astype("<i8").tobytes() + lengths.tobytes() + known.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(t or b"" for t in texts))


def _unpack(data: bytes) -> Docs:
    body = zstandard.ZstdDecompressor().decompress(data)
    (n,) = np.frombuffer(body, "<i8", 1).tolist()
    ids, lengths = np.frombuffer(body, "<i8", n, 8), np.frombuffer(body, "<i8", n, 8 + 8 * n).tolist()
    known = np.frombuffer(body, np.uint8, n, 8 + 16 * n).astype(bool)
    at, texts = 8 + 17 * n, []
    for size in lengths:
        texts.append(None if size < 0 else body[at : at + size])
        at += max(0, size)
    return ids, known, texts


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Docs]:
    ids: list[int | None] = []
    texts: list[bytes | None] = []

    def block() -> Docs:
        return np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool), texts

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                ids.append(key)
                texts.append(text)
                size += len(text or b"")
                if size >= most:
                    yield block()
                    ids, texts, size = [], [], 0
    if ids:
        yield block()


def _masks(rows: pd.DataFrame, stage: int) -> dict[tuple[int, int], bytes]:
    own = rows[rows["stage"] == stage]
    return {(int(r), int(s)): b for r, s, b in zip(own["row"], own["slice"], own["bits"])}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cell_bits: int = CELL_BITS, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed and kept (the words that stay, joined by one space)."""
    small_batches(docs.sparkSession)
    bytes_in = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("bigint"))).first()[0] or 0
    slices, keys = -(-bytes_in // slice_bytes) or 1, (draw_key(), draw_key())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for seq, own in enumerate(_blocks(batches, block_bytes)):
            rows = [(0, base + seq, 0, 0, _pack(*own))]
            block = Block(*own, window, keys, cell_bits)
            for row in range(DEPTH):
                cells, counts = block.sketch(row, slices)
                part = cells >> np.uint64(cell_bits)
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
                for a, b in zip(starts, [*starts[1:], len(part)]):
                    low = cells[a:b] & np.uint64((1 << cell_bits) - 1)
                    data = np.packbits(counts[a:b] > 1).tobytes() + _planes(_gaps(low), 3)
                    rows.append((1, base + seq, row, int(part[a]), (b - a).to_bytes(4, "little") + data))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), arrow)], ["kind", "block", "row", "slice", "data"])

    arrow = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    made = scratch(
        docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(
            build, "kind int, block bigint, row int, slice int, data binary"
        ),
        "substring-blocks", by="kind",
    )
    texts = made.filter("kind = 0").select("block", "data")

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lists, many = [], []
        for data in rows["data"]:
            n = int.from_bytes(data[:4], "little")
            flags = 4 + (n + 7) // 8
            many.append(np.unpackbits(np.frombuffer(data[4:flags], np.uint8), count=n))
            lists.append(np.cumsum(_unplanes(data[flags:], 3)).astype(np.int64))
        sketch = np.zeros(1 << cell_bits, np.uint8)  # counts stop at two
        for cells, flags in zip(lists, many):
            sketch[cells] = np.minimum(2, sketch[cells] + 1 + flags)
        bits = [np.packbits(sketch[cells] > 1).tobytes() for cells in lists]
        keep = [any(b) for b in bits]
        out = pd.DataFrame({"block": rows["block"], "stage": 0, "row": key[0], "slice": key[1], "bits": bits})
        return out[keep]

    reply = "block bigint, stage int, row int, slice int, bits binary"
    sketched = scratch(made.filter("kind = 1").groupBy("row", "slice").applyInPandas(merge, reply), "substring-masks")

    def repeated(text: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        out = {"block": [], "slice": [], "data": []}
        for number, data in zip(text["block"], text["data"]):
            block = Block(*_unpack(data), window, keys, cell_bits)
            part, h1, h2, doc, _ = block.entries(block.estimated_repeated(_masks(masks, 0), slices), slices)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
            for a, b in zip(starts, [*starts[1:], len(part)]):
                low = int(doc[a:b].min())
                ids = _planes((doc[a:b] - low).view(np.uint64), 8)
                out["block"].append(number)
                out["slice"].append(int(part[a]))
                first = _planes(_gaps(h1[a:b]), 8)
                out["data"].append(np.array([b - a, low, len(first)], "<i8").tobytes() + first + h2[a:b].astype("<u8").tobytes() + ids)
        return pd.DataFrame(out)

    def exact(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for data in rows["data"]:
            n, low, size = np.frombuffer(data, "<i8", 3).tolist()
            at = 24 + size
            ids = _unplanes(data[at + 8 * n :], 8).view(np.int64) + low
            parts.append((np.cumsum(_unplanes(data[24:at], 8), dtype=np.uint64), np.frombuffer(data, "<u8", n, at), ids))
        h1, h2, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((h2, h1))
        new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))[: len(order)]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
        smaller = np.empty(len(order), bool)
        smaller[order] = least[np.cumsum(new) - 1] < doc[order]
        bits = [np.packbits(b).tobytes() for b in np.split(smaller, np.cumsum([len(p[0]) for p in parts])[:-1])]
        keep = [any(b) for b in bits]
        return pd.DataFrame({"block": rows["block"], "stage": 1, "row": 0, "slice": key[0], "bits": bits})[keep]

    asked = texts.groupBy("block").cogroup(sketched.groupBy("block")).applyInPandas(repeated, "block bigint, slice int, data binary")
    settled = scratch(asked.groupBy("slice").applyInPandas(exact, reply), "substring-exact")

    def finish(text: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        out = {id_col: [], "n_words": [], "n_removed": [], "kept": []}
        for data in text["data"]:
            block = Block(*_unpack(data), window, keys, cell_bits)
            wanted = block.estimated_repeated(_masks(masks, 0), slices)
            part, _, _, least, number = block.entries(wanted, slices)
            elsewhere = _unmask(part, _masks(masks, 1), 0)
            gone = elsewhere[number] | (block.doc[wanted] > least[number])
            _keep(block, block.at[wanted][gone], out)
        return pd.DataFrame(out | {id_col: pd.array(out[id_col], "Int64")})

    both = sketched.unionByName(settled)
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
    ])
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(finish, schema)


def _keep(block: Block, starts: np.ndarray, out: dict[str, list]) -> None:
    """Adds to out the documents of a block without the words covered by windows from starts on."""
    words = block.words
    delta = np.zeros(len(words.starts) + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + block.window, -1)
    stays = np.cumsum(delta[:-1]) == 0
    for i, (a, b) in enumerate(zip(words.first, words.first[1:])):
        own = stays[a:b]
        out["n_words"].append(int(b - a))
        out["n_removed"].append(int(b - a - own.sum()))
        kept = [words.data[s:e] for s, e in zip(words.starts[a:b][own].tolist(), words.ends[a:b][own].tolist())]
        out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
        out[next(iter(out))].append(int(block.ids[i]) if block.known[i] else None)

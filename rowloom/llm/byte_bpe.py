"""Byte-level BPE through a lazily determinised transducer, and streaming decoding through a UTF-8 state machine.

A prefix of a word has one BPE encoding, whose last token is the only token that ends there and may follow the
last token of the shorter prefix. While bytes are read, only the ends of prefixes from which a longer token could
still grow stay alive. A state of the transducer is what tells these live ends apart: the bytes since the first
of them and, for each, its tokens since their common ancestor. Tokens before the common ancestor can't change any
more and are emitted, so lookahead is bounded by the longest token. States and transitions are made when first
met; once there are MAX_STATES, further ones are made for the word at hand only.

Defined results: a null text encodes as the empty one, to no ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import small_batches

MAX_STATES = 150_000
MAX_WORDS = 100_000
LONG_TEXT = 1 << 18  # characters
KEY, FINAL = "key", "final"
_ALONE = ((0, ()),)  # the live ends of a state that waits for nothing


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a .tiktoken rank file or a tokenizers .json file of byte-level BPE."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = byte_alphabet()
        return {bytes(map(shown.__getitem__, t)): i for t, i in vocab.items() if all(c in shown for c in t)}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def special_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers .json file, by their text."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encodes one word (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.growable = {t[:n] for t in ranks for n in range(len(t))}
        self.merge: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1 and (halves := self._halves(token, rank)):
                self.merge[rank] = halves
                self.joined[halves] = rank
        self.follows: dict[int, bool] = {}
        # a state is a dict: by byte the next state, or it and the tokens emitted; under FINAL the tokens still due, under KEY its key
        self.states: dict[tuple, dict] = {}
        self.start = self._state((b"", -1, _ALONE))

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one: what merges of lower rank leave of its bytes."""
        parts, ranks = [token[i : i + 1] for i in range(len(token))], self.ranks
        while len(parts) > 2:
            low, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if low >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts) if all(p in ranks for p in parts) else None

    def _state(self, key: tuple) -> dict:
        """key: the bytes since the first live end, the token before the common ancestor, and (bytes back, tokens) of each live end.
        If there is no room for one more state, it is made but not kept."""
        if (state := self.states.get(key)) is None:
            state = {KEY: key, FINAL: key[2][-1][1]}
            if len(self.states) < self.max_states:
                self.states[key] = state
        return state

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a directly before token b: undo the merges on both sides of the border, latest
        first, and see whether an earlier merge would have crossed it."""
        key = a << 32 | b
        if (known := self.follows.get(key)) is not None:
            return known
        merge, joined, before, fits = self.merge, self.joined, 1 << 60, True
        while True:
            if joined.get((a, b), before) < before:
                fits = False
                break
            late_a, late_b = merge.get(a), merge.get(b)
            if late_a is None and late_b is None:
                break
            if late_b is None or (late_a is not None and a > b):
                before, a = a, late_a[1]
            else:  # equal merges happen from the left: one that crosses the border goes before b's
                before, b = b + 1, late_b[0]
        if len(self.follows) < 2 * self.max_states:
            self.follows[key] = fits
        return fits

    def _advance(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        tail, lead, ends = state[KEY]
        tail += bytes((byte,))
        size, new = len(tail), None
        for back, tokens in ends:
            token = self.ranks.get(tail[size - back - 1 :])
            if token is not None:
                last = tokens[-1] if tokens else lead
                if last < 0 or self.may_follow(last, token):
                    new = (*tokens, token)
                    break
        if new is None:
            raise ValueError(f"no token fits at byte {byte}")
        grows = self.growable
        live = [(back + 1, tokens) for back, tokens in ends if tail[size - back - 1 :] in grows]
        if not live:  # nothing before this end can change any more
            out, key = new, (b"", new[-1], _ALONE)
        else:
            live.append((0, new))
            low, high = min(t for _, t in live), max(t for _, t in live)
            n = 0
            for x, y in zip(low, high):
                if x != y:
                    break
                n += 1
            out = low[:n]
            if len(low) == n:  # the common ancestor is itself a live end
                lead = out[-1] if n else lead
            else:
                lead = -2
            key = (tail[size - live[0][0] :], lead, tuple([(back, t[n:]) for back, t in live]) if n else tuple(live))
        to = self._state(key)
        if key in self.states:
            state[byte] = (to, out) if out else to
        return to, out

    def encode(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in word:
            try:
                hop = state[byte]
            except KeyError:
                hop = self._advance(state, byte)
            if type(hop) is dict:
                state = hop
            else:
                state, emitted = hop
                out += emitted
        out += state[FINAL]
        return out


class _Words(dict):
    """Encoded words, as bytes of little-endian 32-bit ids. When there are too many, only those used since the last such
    time are kept."""

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.most, self.older = machine, most, {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is None:
            raw = word.encode("utf-8", "surrogatepass")
            ids = array("i", self.machine.encode(raw)).tobytes()
            if len(raw) > 64:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        compiled = regex.compile(pattern)
        self.split, self.matches = compiled.findall, compiled.finditer
        self.machine = Transducer(load_ranks(path))
        self.words = _Words(self.machine, MAX_WORDS)

    def encode_raw(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out, matches = bytearray(), self.matches(text)  # a long text's words never lie in memory all at once
        while words := [m[0] for m in islice(matches, 1 << 14)]:
            out += b"".join(map(self.words.__getitem__, words))
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), dtype="<i4").tolist()


class Utf8Machine:
    """UTF-8 as a state machine. A state is the bytes of an unfinished character; bytes that can't continue it give U+FFFD."""

    # Fixed values of the Unicode standard, table 3-7: lead bytes, bytes in all, and the range of the second byte.
    LEADS = (
        (0x00, 0x7F, 1, 0, 0),
        (0xC2, 0xDF, 2, 0x80, 0xBF),
        (0xE0, 0xE0, 3, 0xA0, 0xBF),
        (0xE1, 0xEC, 3, 0x80, 0xBF),
        (0xED, 0xED, 3, 0x80, 0x9F),
        (0xEE, 0xEF, 3, 0x80, 0xBF),
        (0xF0, 0xF0, 4, 0x90, 0xBF),
        (0xF1, 0xF3, 4, 0x80, 0xBF),
        (0xF4, 0xF4, 4, 0x80, 0x8F),
    )

    def __init__(self):
        self.lead = {b: (n, lo, hi) for first, last, n, lo, hi in self.LEADS for b in range(first, last + 1)}

    def push(self, held: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            if held:
                n, lo, hi = self.lead[held[0]]
                if (lo if len(held) == 1 else 0x80) <= byte <= (hi if len(held) == 1 else 0xBF):
                    held += bytes((byte,))
                    if len(held) == n:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.lead:
                held = bytes((byte,))
            else:
                out.append("�")
        return "".join(out), held


class Decoder:
    """Ids to text, piece by piece: the state between pieces is what Utf8Machine holds. Hops by (state, id) are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.machine, self.token = Utf8Machine(), {i: t for t, i in ranks.items()}
        self.hops: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        size = max(self.token, default=-1) + 1
        self.whole: list[str | None] = [None] * size  # tokens that are whole characters, met with nothing held
        for i, t in self.token.items():
            text, held = self.machine.push(b"", t)
            if not held and "�" not in text:
                self.whole[i] = text

    def push(self, held: bytes, ids: Iterable[int]) -> tuple[str, bytes]:
        ids = ids if isinstance(ids, list) else list(ids)
        whole = self.whole
        if not held:
            try:
                return "".join(map(whole.__getitem__, ids)), b""
            except TypeError:  # a token that is no whole characters
                pass
        out, hops = [], self.hops
        for i in ids:
            if not held and whole[i] is not None:
                out.append(whole[i])
                continue
            if (hop := hops.get((held, i))) is None:
                hop = hops[held, i] = self.machine.push(held, self.token[i])
            out.append(hop[0])
            held = hop[1]
        return "".join(out), held

    def decode(self, ids: Iterable[int]) -> str:
        text, held = self.push(b"", ids)
        return text + "�" * bool(held)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def _with(batch: pa.RecordBatch, keep: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), column], [*keep, name])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df without its text and with an array<int> column of ids; path is that of the rank file on every executor."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few whole texts at a time
                part = batch.slice(at, 64)
                raw = [own.encode_raw(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
                yield _with(part, keep, ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))))

    fields = [df.schema[c] for c in keep]
    return df.select(*[f"`{c}`" for c in [*keep, text]]).mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", piece: int = 1 << 16) -> DataFrame:
    """df with the text of its ids added, decoded `piece` ids at a time. Null ids give an empty text."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = []
            for i in range(batch.num_rows):
                values = column[i].values
                numbers = [] if values is None else values.to_numpy(zero_copy_only=False)
                out, held = [], b""
                for at in range(0, len(numbers), piece):
                    got, held = own.push(held, numbers[at : at + piece].tolist())
                    out.append(got)
                texts.append("".join(out) + "�" * bool(held))
            yield _with(batch, keep, text, pa.array(texts, pa.string()))

    fields = [df.schema[c] for c in keep]
    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType())]))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")

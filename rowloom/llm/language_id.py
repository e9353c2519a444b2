"""Language identification by cross-parsing against suffix automata.

One suffix automaton per language is built from a bounded sample of labelled text. A text is parsed greedily into the
longest pieces that occur in a language's sample; n symbols in c phrases give the cross-entropy estimate
c * log2(sample size) / n bits per symbol (Ziv and Merhav), and the language with the fewest bits wins. Whole texts
are parsed, in segments of SEGMENT symbols that all advance together, one array operation per symbol; a segment
starts a new phrase. Texts are folded PART characters at a time, and a part ends a segment. The transitions of all automata interlock in
one array, so memory follows the samples, whatever the alphabets.

Defined results: `und` with score 0 for a null text or one without a letter, or if nothing could be learned; ties go
to the language that sorts first; repeated rows get equal results, and rows that share a key are drawn once; a row with a null key, label
or text teaches nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import small_batches

SAMPLE_DOCS = 200  # labelled rows per language that are learned from
SAMPLE_PASSAGE = 100  # characters of each of them, from a place drawn by its key
MAX_LANGS = 256  # the most frequent labels
SEGMENT = 512
PART = 1 << 20
BATCH_SYMBOLS = 2_000_000
WIDE = 64  # transitions of a state from which on its row isn't searched a place for
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0]) if low[0].isalpha() else c
    return out


def fold(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one space for each run of anything else, none at the ends."""
    points = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = points == 0x20
    points = points[~(space & np.append(True, space[:-1]))] if len(points) else points
    return points[:-1] if len(points) and points[-1] == 0x20 else points


def suffix_automaton(symbols: list[int]) -> tuple[int, np.ndarray]:
    """The number of states, and the transitions (state, symbol, next state), of the automaton of all substrings."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(s) == q:
                    nxt[p][s] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return len(nxt), np.array([(i, s, t) for i, own in enumerate(nxt) for s, t in own.items()], np.int64).reshape(-1, 3)


class Transitions:
    """Transitions of many states in one array. A state is a number of its own, its base; the cell base + symbol holds, if it is the
    state's, that base and the next one. Rows of states interlock, so there are hardly more cells than transitions."""

    def __init__(self, edges: np.ndarray, states: int, width: int):
        """edges: state, symbol, next state."""
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        start = np.searchsorted(edges[:, 0], np.arange(states + 1))
        count = np.diff(start)
        symbols = edges[:, 1]
        wide = [symbols[start[s] : start[s + 1]] for s in np.flatnonzero(count > WIDE)]
        room = 2 * width + 4 * len(edges) + 128 * width + sum(int(own[-1]) + 2 for own in wide)
        free, used = np.ones(room + width, bool), np.zeros(room + width, bool)
        free[:width] = False  # so that no base is below zero
        base = np.full(states, room, np.int64)  # of states without transitions: no cell is theirs
        top = width
        for state, own in zip(np.flatnonzero(count > WIDE).tolist(), wide):  # beyond all that is taken; others fill their gaps
            chosen = base[state] = top - own[0]
            used[chosen] = True
            free[chosen + own] = False
            top = chosen + own[-1] + 1
        begin = width  # searches start here; what they leave behind takes the states of one transition
        for state in np.argsort(-count, kind="stable")[len(wide) : int((count > 1).sum())].tolist():
            own = symbols[start[state] : start[state + 1]]
            while True:
                bases = np.flatnonzero(free[begin : begin + 256]) + (begin - own[0])
                bases = bases[~used[bases]]
                for s in own[1:]:
                    bases = bases[free[bases + s]]
                if len(bases):
                    break
                begin += 64
            chosen = base[state] = bases[0]
            used[chosen] = True
            free[chosen + own] = False
        holes = np.flatnonzero(free[:room])
        alone = np.flatnonzero(count == 1)
        alone = alone[np.argsort(symbols[start[alone]], kind="stable")]
        groups = np.flatnonzero(np.diff(symbols[start[alone]], prepend=-1))
        at = 0
        for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(alone)]):
            s = symbols[start[alone[a]]]
            while a < b:  # holes that don't fit are left
                some = holes[at : at + b - a + 8]
                some = some[~used[some - s]][: b - a]
                base[alone[a : a + len(some)]] = some - s
                used[some - s] = True
                at = int(np.searchsorted(holes, some[-1], side="right")) if len(some) else at + 8
                a += len(some)
        last = int(max(base[base < room], default=0)) + 1
        self.base, self.none = np.minimum(base, last), last
        self.cells = np.full(last + width, -1, np.int64)
        self.cells[base[edges[:, 0]] + symbols] = base[edges[:, 0]] << 32 | self.base[edges[:, 2]]

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a transition, and the base of the state it leads to (anything if there is none)."""
        cell = self.cells[state + symbol]
        return cell >> 32 == state, cell & 0xFFFFFFFF


class Model:
    """samples: by language, folded text."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.langs = sorted(samples)
        self.letters = np.unique(np.concatenate([*samples.values(), np.array([0x20], np.uint32)]))
        width = len(self.letters) + 1  # the last symbol stands for letters that no sample has
        self.bits = np.array([np.log2(max(2, len(samples[lang]))) for lang in self.langs])
        edges, roots, at = [], [], 0
        for lang in self.langs:
            states, own = suffix_automaton(np.searchsorted(self.letters, samples[lang]).tolist())
            edges.append(own + np.array([at, 0, at]))
            roots.append(at)
            at += states
        self.next = Transitions(np.concatenate(edges), at, width)
        self.roots = self.next.base[roots]
        every = np.arange(width)
        leads, first = self.next(self.roots[:, None], every)
        self.first = np.where(leads, first, self.next.none)  # from the roots; a symbol that a sample doesn't have is a phrase by itself

    @cached_property
    def symbol(self) -> np.ndarray:
        out = np.full(0x110000, len(self.letters), np.int32)
        out[self.letters] = np.arange(len(self.letters))
        return out

    def phrases(self, folded: list[np.ndarray]) -> np.ndarray:
        """[text, language]: how many phrases the text takes."""
        langs = len(self.langs)
        counts = np.zeros((len(folded), langs), np.int64)
        pieces = [(i, a) for i, t in enumerate(folded) for a in range(0, len(t), SEGMENT)]
        if not pieces:
            return counts
        owner = np.array([i for i, _ in pieces])
        size = np.array([min(SEGMENT, len(folded[i]) - a) for i, a in pieces])
        begin = np.cumsum([0, *map(len, folded)])[owner] + np.array([a for _, a in pieces])
        order = np.argsort(-size, kind="stable")
        owner, size, begin = owner[order], size[order], begin[order]
        text = self.symbol[np.concatenate(folded)]
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # segments longer than each step
        state = np.repeat(self.roots[:, None], len(size), axis=1)
        found = np.ones((langs, len(size)), np.int32)
        for step in range(int(size[0])):
            n = active[step]
            symbols = text[begin[:n] + step]
            leads, now = self.next(state[:, :n], symbols)
            if step:
                found[:, :n] += ~leads
            state[:, :n] = np.where(leads, now, self.first[:, symbols])
        for k in range(langs):
            counts[:, k] = np.bincount(owner, found[k], len(folded))
        return counts

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        counts, sizes = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []

        def count() -> None:
            own = [i for i, _ in held]
            np.add.at(counts, own, self.phrases([f for _, f in held]))
            np.add.at(sizes, own, [len(f) for _, f in held])
            held.clear()

        total = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), PART):
                held.append((i, fold(text[at : at + PART])))
                total += len(held[-1][1])
                if total >= BATCH_SYMBOLS:
                    count()
                    total = 0
        count()
        out = []
        for n, row in zip(sizes, counts * self.bits / np.maximum(sizes, 1)[:, None]):
            if not n:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            out.append((self.langs[best], float(1 - row[best] / rest.min()) if len(rest) else 1.0))
        return out


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model({lang: np.array(list(map(ord, text)), np.uint32) for lang, text in samples})


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, passage: int = SAMPLE_PASSAGE, max_langs: int = MAX_LANGS) -> tuple[tuple[str, str], ...]:
    """A bounded sample for each of the `max_langs` most frequent languages: a passage of each of about `sample_docs` rows, chosen by a
    hash of the key, from a place that the hash draws too, so that no part of the rows or texts is preferred. Every row counts alike,
    and so does every language that has enough rows."""
    rows = labelled.select(F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).dropna()
    sizes = {r[0]: r[1] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()}
    if not sizes:
        return ()
    share = F.coalesce(*[F.when(F.col("l") == l, F.lit(min(1.0, sample_docs / n))) for l, n in sorted(sizes.items())])
    draw = (F.xxhash64(F.lit("sample"), "k").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).alias("draw")
    place = F.pmod(F.xxhash64(F.lit("place"), "k"), F.greatest(F.char_length("t") - passage + 1, F.lit(1))).cast("int") + 1
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share).select("l", "k", F.struct("draw", F.substring("t", place, F.lit(passage)).alias("t")).alias("p"))
    once = drawn.groupBy("l", "k").agg(F.min("p").alias("p")).select("l", "p.draw", "p.t")  # rows that share a key are one
    texts: dict[str, list[np.ndarray]] = {}
    for r in sorted(once.orderBy("draw", "l").limit(4 * sample_docs * len(sizes)).collect(), key=lambda r: (r.l, r.draw, r.t)):
        if len(f := fold(r.t)):
            texts.setdefault(r.l, []).append(f)
    return tuple((l, "".join(map(chr, np.concatenate([np.append(p, 0x20) for p in parts])))) for l, parts in sorted(texts.items()))


def identify(df: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """df with lang_pred and score (the share by which the runner-up needs more bits) added."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    at_text = keep.index(text)
    model = _model(samples) if samples else None  # made once, and sent to the tasks: a few bytes for each symbol of the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            got = model.predict(texts) if model else [(UNDETERMINED, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"]
            )

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def fold_number(key: Column, folds: int = 3) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))

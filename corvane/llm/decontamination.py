"""Benchmark decontamination with an FM-index per training shard.

Every task cuts its documents into shards of bounded size and builds for each an index
over word symbols: suffix array, Burrows-Wheeler transform, wavelet matrix, and text
positions sampled at every ``SAMPLE``-th place. Windows of the benchmark are matched by
backward search, all at once; their occurrences are located by walking back to a sampled
position; the spans they cover are merged per document.

Nothing is shuffled and a shard never leaves its task, so memory is bounded by
``shard_words`` and not by the table, and a lost executor costs the shards it held. A
document longer than a shard is cut into overlapping parts. The benchmark is sent to the
executors in blocks of at most ``block_words`` words, of which a worker holds one at a time;
all blocks are searched in the same index. A pass takes blocks of at most ``pass_words`` words
together; a larger benchmark needs further passes, which add to the spans found so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from corvane.llm.common import materialise, small_batches, words_of

SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, by doubling; only still tied suffixes are sorted again.

    A suffix that is a prefix of another comes first.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    width = max(1, int(s.max() + 1).bit_length())
    k = max(1, 62 // width)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(k, dtype=np.int64)])
    base = int(s.max()) + 2
    k = 1
    while base ** (k + 1) < 2**62 and k < 8:
        k += 1
    for j in range(k):
        key = key * base + padded[j : j + n]
    order = np.argsort(key, kind="stable")
    sk = key[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(sk[1:], sk[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    group = np.repeat(starts, np.diff(np.append(starts, n)))  # rank: first place of the group
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = group
    sizes = np.diff(np.append(starts, n))
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = k
    while len(tied):
        suffix = order[tied]
        first = rank[suffix]
        second = rank[np.minimum(suffix + h, n)]
        by = np.lexsort((second, first)) if n >= 2**31 else np.argsort((first << 32) | (second + 1), kind="stable")
        suffix, first, second = suffix[by], first[by], second[by]
        order[tied] = suffix
        new = np.empty(len(tied), dtype=bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(tied)))
        rank[suffix] = np.repeat(tied[starts], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


class Bits:
    """A bit vector with rank: the bits, and the ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        words = len(bits) // 64 + 1
        packed = np.zeros(words * 8, dtype=np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        count = np.bitwise_count(self.words)
        self.before = np.zeros(words + 1, dtype=np.int32)
        np.cumsum(count, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def __len__(self) -> int:
        """All ones."""
        return int(self.before[-1])


class WaveletMatrix:
    """Rank and access over a sequence of symbols, one bit plane per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.planes: list[Bits] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            on = (cur >> level) & 1 == 1
            self.planes.append(Bits(on))
            self.zeros.append(len(seq) - len(self.planes[-1]))
            cur = np.concatenate([cur[~on], cur[on]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at
        for i, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            on = (symbol >> (self.levels - 1 - i)) & 1 == 1
            a, b = plane.rank(lo), plane.rank(hi)
            lo = np.where(on, zeros + a, lo - a)
            hi = np.where(on, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place's symbol and how often it occurs before."""
        symbol, lo, p = np.zeros_like(at), np.zeros_like(at), at
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            a, b, on = plane.rank(lo), plane.rank(p), plane.get(p)
            symbol = (symbol << 1) | on
            lo = np.where(on, zeros + a, lo - a)
            p = np.where(on, zeros + b, p - b)
        return symbol, p - lo


class FmIndex:
    """Index over one shard: symbols from 1 up; 0 is kept for the end.

    Of the text positions only every ``SAMPLE``-th is kept, in the order of the suffixes, beside
    a bit for each suffix that says whether its position is there.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        s = np.append(text.astype(np.int64), 0)
        order = suffix_array(s)
        self.n = len(s)
        self.before = np.zeros(symbols + 1, dtype=np.int64)  # suffixes that start with a smaller symbol
        np.cumsum(np.bincount(s, minlength=symbols), out=self.before[1:])
        self.tree = WaveletMatrix(s[order - 1].astype(np.int32), symbols)
        sampled = order % SAMPLE == 0
        self.marked, self.places = Bits(sampled), order[sampled].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns (one per row), last symbol first."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            a = self.before[c] + self.tree.rank(c, lo[alive])
            b = self.before[c] + self.tree.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out = np.full(len(rows), -1, dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            found = self.marked.get(at)
            out[todo[found]] = (self.places[self.marked.rank(at[found])] + steps) % self.n
            todo, at = todo[~found], at[~found]
            if len(todo):
                c, r = self.tree.access_rank(at)
                at = self.before[c] + r
                steps += 1
        return out


@dataclass
class Windows:
    """Distinct windows of a block of the benchmark, and the items each belongs to.

    A window is a place in ``ids`` and a length. Windows are numbered by length, then in the order of
    ``starts``; those of window w are ``owner[first_owner[w]:first_owner[w + 1]]``.
    """

    words: list[bytes]
    ids: np.ndarray  # words of all items, one after the other, by their number in ``words``
    starts: dict[int, np.ndarray]  # window length to places of its windows
    first_owner: np.ndarray
    owner: np.ndarray
    items: list[str]

    def lengths(self) -> np.ndarray:
        return np.concatenate([np.full(len(v), k) for k, v in self.starts.items()] or [np.zeros(0)]).astype(np.int64)


def benchmark_windows(items: list[tuple[str, list[bytes]]], width: int = 10) -> Windows:
    """All runs of ``width`` words; an item with fewer, but not none, is one window."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for _, ws in items for w in ws], dtype=np.int32)
    names = sorted({i for i, _ in items})
    place = {n: k for k, n in enumerate(names)}
    runs: dict[int, list[tuple[np.ndarray, int]]] = {}
    at = 0
    for item, ws in items:
        k = min(width, len(ws))
        if k:
            runs.setdefault(k, []).append((np.arange(at, at + len(ws) - k + 1), place[item]))
        at += len(ws)
    starts, counts, owners = {}, [], []
    for k in sorted(runs):
        every = np.concatenate([r for r, _ in runs[k]])
        own = np.repeat([o for _, o in runs[k]], [len(r) for r, _ in runs[k]])
        rows = np.ascontiguousarray(ids[every[:, None] + np.arange(k)]).view(np.dtype((np.void, 4 * k))).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        starts[k] = every[first].astype(np.int32)
        pair = np.unique(which.ravel().astype(np.int64) * len(names) + own)
        counts.append(np.bincount(pair // len(names), minlength=len(first)))
        owners.append(pair % len(names))
    none = [np.zeros(0, dtype=np.int64)]
    first_owner = np.concatenate([[0], np.cumsum(np.concatenate(counts or none))])
    return Windows(list(number), ids, starts, first_owner, np.concatenate(owners or none).astype(np.int32), names)


class Shard:
    """Documents of one shard under an index: symbol 0 ends it, then one separator per document, so
    that ties end with a document, then its words."""

    def __init__(self, docs: list[tuple[int, int, list[bytes]]]):
        """``docs``: (number, place of the first word given, words)."""
        self.docs, self.separators = docs, len(docs) + 1
        self.vocab: dict[bytes, int] = {}
        lengths = np.array([len(w) for _, _, w in docs])
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.empty(int(self.starts[-1]), dtype=np.int64)
        for i, (_, _, ws) in enumerate(docs):
            a = int(self.starts[i])
            for w in ws:
                if w not in self.vocab:
                    self.vocab[w] = len(self.vocab)
            text[a : a + len(ws)] = np.fromiter(map(self.vocab.__getitem__, ws), dtype=np.int64, count=len(ws))
            text[a + len(ws)] = i - len(docs)
        text += self.separators
        self.index = FmIndex(text, self.separators + len(self.vocab))

    def find(self, windows: Windows, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: number of the document, first word, number of the window."""
        # benchmark words that the shard lacks get no symbol, and their windows are left out
        symbol = np.array([self.vocab.get(w, -1) for w in windows.words], dtype=np.int64)
        symbol[symbol >= 0] += self.separators
        text = symbol[windows.ids]
        unknown = np.concatenate([[0], np.cumsum(text < 0)])
        where, which, base = [], [], 0
        for length, starts in windows.starts.items():
            known = np.flatnonzero(unknown[starts + length] == unknown[starts])
            for i in range(0, len(known), chunk):
                some = known[i : i + chunk]
                lo, hi = self.index.search(text[starts[some][:, None] + np.arange(length)])
                hit = np.flatnonzero(hi > lo)
                n = (hi - lo)[hit]
                first = np.repeat(np.cumsum(n) - n, n)
                where.append(self.index.locate(np.repeat(lo[hit], n) + (np.arange(n.sum()) - first)))
                which.append(np.repeat(some[hit] + base, n))
            base += len(starts)
        if not where:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        at, window = np.concatenate(where), np.concatenate(which)
        doc = np.searchsorted(self.starts, at, side="right") - 1
        number = np.array([d[0] for d in self.docs], dtype=np.int64)
        offset = np.array([d[1] for d in self.docs], dtype=np.int64)
        return number[doc], at - self.starts[doc] + offset[doc], window


def _shards(texts: list[list[bytes]], shard_words: int, overlap: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (number, place of the first word, words), at most ``shard_words`` words each."""
    shard, size = [], 0
    step = max(1, shard_words - overlap)
    for number, ws in enumerate(texts):
        if not ws:
            continue
        for a in range(0, max(1, len(ws) - overlap), step) if len(ws) > shard_words else (0,):
            part = ws[a : a + step + overlap] if len(ws) > shard_words else ws
            if shard and size + len(part) > shard_words:
                yield shard
                shard, size = [], 0
            shard.append((number, a, part))
            size += len(part)
    if shard:
        yield shard


class Blocks:
    """The blocks of one pass, on the executors. A worker loads one at a time and lets it go."""

    def __init__(self, spark: SparkSession, blocks: list[list[tuple[str, list[bytes]]]], width: int):
        self.width = width
        self.sent = [spark.sparkContext.broadcast(benchmark_windows(b, width)) for b in blocks]

    def __iter__(self) -> Iterator[Windows]:
        for b in self.sent:
            yield b.value
            if len(self.sent) > 1:
                vars(b).pop("_value", None)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted and joined where they meet, end exclusive."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def find_spans(texts: list[list[bytes]], blocks: Blocks, shard_words: int) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Merged spans of hit words and items with an occurring window, for each text that has any."""
    found: dict[int, tuple[set[tuple[int, int]], set[str]]] = {}
    for shard in _shards(texts, shard_words, blocks.width - 1):
        index = Shard(shard)
        for windows in blocks:
            lengths = windows.lengths()
            for n, first, w in zip(*(x.tolist() for x in index.find(windows)), strict=True):
                spans, items = found.setdefault(n, (set(), set()))
                spans.add((first, first + int(lengths[w])))
                items.update(windows.items[o] for o in windows.owner[windows.first_owner[w] : windows.first_owner[w + 1]])
    return {n: (merged(spans), items) for n, (spans, items) in found.items()}


#: What a search adds to a row, and how Arrow names its types.
HITS = {
    "__n_words": ("long", pa.int64()),
    "__starts": ("array<int>", pa.list_(pa.int32())),
    "__ends": ("array<int>", pa.list_(pa.int32())),
    "__items": ("array<string>", pa.list_(pa.string())),
}


def scan(rows: DataFrame, blocks: Blocks, text_col: str, keep: list[str], shard_words: int) -> DataFrame:
    """One pass: the columns to ``keep`` and ``HITS``, added to those that ``rows`` has from earlier passes."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            texts = [words_of(t) for t in b.column(at[text_col]).to_pylist()]
            found = find_spans(texts, blocks, shard_words)
            old = [b.column(at[c]).to_pylist() if c in at else [()] * len(texts) for c in ("__starts", "__ends", "__items")]
            starts, ends, items = [], [], []
            for n, (s, e, i) in enumerate(zip(*old, strict=True)):
                spans, more = found.get(n, ((), ()))
                every = merged([*zip(s, e, strict=True), *spans])
                starts.append([a for a, _ in every])
                ends.append([z for _, z in every])
                items.append(sorted({*i, *more}))
            new = ([len(t) for t in texts], starts, ends, items)
            columns = [pa.array(c, k) for c, (_, k) in zip(new, HITS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in keep), *columns], [*keep, *HITS])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} {k}" for c, (k, _) in HITS.items())])
    return small_batches(rows).mapInArrow(run, schema)


def search(rows: DataFrame, passes: list[list[list[tuple[str, list[bytes]]]]], text_col: str, keep: list[str], width: int, shard_words: int) -> DataFrame:
    """All passes; between two of them the rows are written, so that no more than one pass's blocks are in use."""
    spark = rows.sparkSession
    for k, blocks in enumerate(passes):
        last = k == len(passes) - 1
        names = keep if last else [*keep, *({text_col} - set(keep))]
        rows = scan(rows, Blocks(spark, blocks, width), text_col, names, shard_words)
        rows = rows if last else materialise(rows, "pass")
    return rows


_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what separates words stays, once per span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : at[a][0]])
        pos = at[b - 1][1]
    return "".join([*out, text[pos:]])


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 1 << 18, block_words: int = 500_000, pass_words: int = 8_000_000
) -> DataFrame:
    """``docs`` without the words that lie in an occurrence of a benchmark window.

    Rows that had none stay as they were, null and empty texts among them. From the others the merged
    spans are cut until no window is left, and ``n_chars``, if there, is set anew; those left
    without any word go. Columns stay the same. Ids aren't looked at: rows without one, and rows
    that repeat one, are handled like others. An empty table gives no rows, an empty benchmark
    cuts nothing.
    """
    schema = docs.schema
    passes = benchmark_passes(benchmark, block_words, pass_words)
    if not passes:
        return docs
    at, sized = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def renewed(b: pa.RecordBatch, texts: list[str | None], changed: list[bool], gone: list[bool]) -> pa.RecordBatch:
        columns = list(b.columns)
        columns[at] = pa.array(texts, pa.string())
        if sized is not None:
            was = b.column(sized)
            columns[sized] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, was.to_pylist(), strict=True)], was.type)
        return pa.RecordBatch.from_arrays(columns, b.schema.names).filter(pa.array([not g for g in gone], pa.bool_()))

    if len(passes) == 1:
        blocks = Blocks(docs.sparkSession, passes[0], width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at).to_pylist()
                changed, todo = [False] * len(texts), list(range(len(texts)))
                while todo:  # what is left on both sides of a cut may form a window anew
                    found = find_spans([words_of(texts[n]) for n in todo], blocks, shard_words)
                    todo = [todo[k] for k in sorted(found)]
                    for n, (spans, _) in zip(todo, (found[k] for k in sorted(found)), strict=True):
                        texts[n], changed[n] = cut(texts[n], spans), True
                if any(changed):
                    gone = [c and not _WORD.search(t) for t, c in zip(texts, changed, strict=True)]
                    yield renewed(b, texts, changed, gone)
                else:
                    yield b

        return small_batches(docs).mapInArrow(run, schema)

    names = [f"c{i}" for i in range(len(schema.fields))]  # they can't clash with those of the search

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            starts, ends = b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2).to_pylist()
            changed = [bool(s) for s in starts]
            texts = [cut(t, list(zip(s, e, strict=True))) if s else t for t, s, e in zip(texts, starts, ends, strict=True)]
            rows = pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(changed, pa.bool_())], [*names, "__cut"])
            yield renewed(rows, texts, changed, [c and not _WORD.search(t) for t, c in zip(texts, changed, strict=True)])

    kinds = [StructField(n, f.dataType, True) for n, f in zip(names, schema.fields, strict=True)]
    done, todo = None, docs.toDF(*names)
    while True:  # a row may be cut only when all passes have searched it
        found = search(todo, passes, names[at], names, width, shard_words)
        held = materialise(found.mapInArrow(rewrite, StructType([*kinds, StructField("__cut", BooleanType())])), "cut")
        clean = held.where("NOT __cut").drop("__cut")
        done, todo = clean if done is None else done.unionByName(clean), held.where("__cut").drop("__cut")
        if todo.isEmpty():
            return done.toDF(*docs.columns)


def benchmark_passes(benchmark: DataFrame, block_words: int, pass_words: int) -> list[list[list[tuple[str, list[bytes]]]]]:
    """Items as (id as text, words), in blocks and these in passes of bounded size.

    Items without words or without an id are left out. The driver reads the whole benchmark.
    """
    passes: list[list[list[tuple[str, list[bytes]]]]] = []
    size = in_pass = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        ws = words_of(r.text)
        if not ws or r.i is None:
            continue
        if not passes or in_pass + len(ws) > pass_words:
            passes.append([[]])
            size = in_pass = 0
        elif size + len(ws) > block_words:
            passes[-1].append([])
            size = 0
        passes[-1][-1].append((r.i, ws))
        size, in_pass = size + len(ws), in_pass + len(ws)
    return passes


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    shard_words: int = 1 << 18,
    block_words: int = 500_000,
    pass_words: int = 8_000_000,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, hit_starts, hit_ends, items``.

    ``hit_starts`` and ``hit_ends`` are the merged spans of hit words, ``items`` the ids of
    items with an occurring window, sorted as strings. A null or empty text has no words and
    no hits. An empty benchmark hits nothing. Items that repeat an id are one item; null ids
    are left out. Rows are searched one by one, so those that repeat an id, or have none, give a row
    each, whatever the size of the benchmark. An empty table gives no rows. Other columns are ignored.
    """
    passes = benchmark_passes(benchmark, block_words, pass_words) or [[[]]]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = search(rows, passes, "text", ["doc_id"], width, shard_words)
    return found.select("doc_id", *(F.col(a).alias(b) for a, b in zip(HITS, ("n_words", "hit_starts", "hit_ends", "items"), strict=True)))

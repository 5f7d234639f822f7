"""Collocations of two to four words by pivot partitioning.

Words get a total order from rare to common: by a table of counts of hashed words (``cells`` bytes, which travel to the
tasks whatever the corpus holds) and then by hash. The pivot of a phrase is its rarest word. For each occurrence of a word,
the text around it is cut down to the fragment in which it is the pivot: up to three words to either side, ending before any
rarer word (and, on the left, before the word itself, so that each occurrence of a phrase lies in one fragment), and
before words that are too rare for any phrase. Equal fragments are counted in the task that reads the text, and
fragments go to their pivot, where all phrases that the pivot owns are counted and the rare ones dropped at once.

A word with more than its share of fragments is split by fragment over several partitions; their counts are added
afterwards. The order only decides where a phrase is counted; the counts are exact whatever the table says.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialise, small_batches

LONGEST = 4
_UPPER = range(65, 91)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case and all ends of pieces to one of them, which no word can hold.
_TABLE = bytes(b + 32 if b in _UPPER else 46 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_NEVER = np.iinfo(np.int64).max
_TEXT_BYTES = 4_000_000


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Normalised texts of a batch, those of a language together, about ``_TEXT_BYTES`` at a time."""
    texts: dict[str, list[bytes]] = defaultdict(list)
    held: Counter[str] = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        texts[lang].append(text.as_py())
        held[lang] += len(texts[lang][-1])
        if held[lang] > _TEXT_BYTES:
            yield lang, b".".join(texts.pop(lang)).translate(_TABLE)
            del held[lang]
    for lang, parts in texts.items():
        yield lang, b".".join(parts).translate(_TABLE)


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\n" + word) >> 1


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("h", pa.int64()), ("f", pa.int64())])
_FRAGMENTS = pa.schema([("lang", pa.string()), ("pivot", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("fragments", pa.binary()), ("weights", pa.binary())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("a", pa.int64())])


def word_counts(texts: DataFrame, held_words: int = 500_000) -> DataFrame:
    """``lang, word, h, f`` over ``lang, text`` (binary): all words with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)

        def flushed() -> pa.RecordBatch:
            rows = [(lang, w, _hash(lang, w), n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return _rows(list(zip(*rows, strict=True)) or [[]] * 4, _WORDS)

        for batch in batches:
            for lang, text in _by_lang(batch):
                counts[lang].update(text.replace(b".", b" ").split())
                if sum(map(len, counts.values())) > held_words:
                    yield flushed()
        yield flushed()

    found = small_batches(texts).mapInArrow(run, "lang string, word binary, h long, f long")
    return found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("f").alias("f"))


class Order:
    """The table of counts: quarter powers of two of what each cell holds, 0 for too little."""

    def __init__(self, words: DataFrame, least: int, cells: int):
        cell = F.col("h").bitwiseAND(F.lit(cells - 1)).cast("int")
        full = words.groupBy(cell.alias("cell")).agg(F.sum("f").alias("f")).where(F.col("f") >= least).toArrow()
        self.cells = cells
        self.table = np.zeros(cells, dtype=np.uint8)
        power = np.floor(np.log2(np.maximum(full.column("f").to_numpy(), 1).astype(np.float64)) * 4)
        self.table[full.column("cell").to_numpy()] = np.minimum(power + 1, 255)

    def key(self, h: int) -> int:
        """Rarer words have larger keys; a word too rare for any phrase has the largest."""
        power = int(self.table[h & (self.cells - 1)])
        return (255 - power) << 54 | h >> 9 if power else _NEVER

    def most(self, keys: np.ndarray) -> np.ndarray:
        """A bound of the occurrences of words with these keys."""
        return 2.0 ** ((255 - (keys >> 54)) / 4)


class _Keys(dict):
    """Keys of the words of one language, remembered up to a bound."""

    def __init__(self, lang: str, order: Order):
        super().__init__()
        self.lang, self.order = lang, order

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        k = self[word] = _NEVER if word == b"." else self.order.key(_hash(self.lang, word))
        return k


def _fragments(text: bytes, keys: _Keys) -> Iterator[tuple[int, list[bytes]]]:
    """For each number of words left of the pivot, the fragments of a text with so many."""
    tokens = text.replace(b".", b" . ").split()
    n = len(tokens)
    pad = np.full(LONGEST - 1, _NEVER)
    key = np.concatenate([pad, np.fromiter(map(keys.__getitem__, tokens), np.int64, n), pad])
    own = key[LONGEST - 1 : LONGEST - 1 + n]
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    more_left, more_right = own < _NEVER, own < _NEVER
    for k in range(1, LONGEST):
        more_left = more_left & (key[LONGEST - 1 - k : LONGEST - 1 - k + n] < own)
        more_right = more_right & (key[LONGEST - 1 + k : LONGEST - 1 + k + n] <= own)
        left, right = left + more_left, right + more_right
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    for k in range(LONGEST):
        at = np.flatnonzero((left == k) & (left + right > 0))
        if len(at):
            yield k, [line[a:b] for a, b in zip(starts[at - k].tolist(), (ends[at + right[at]] - 1).tolist(), strict=True)]


def _binary(starts: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype("<i4").tobytes()), pa.py_buffer(data)])


def _grouped(lang: str, lines: list[bytes], pivots: np.ndarray, weights: np.ndarray, order_of: Order, unit: float) -> Iterator[pa.RecordBatch]:
    """A row for each pivot, or part of one that is split: its fragments, a line each, and their numbers."""
    salts = np.maximum(1, np.ceil(order_of.most(pivots) / unit)).astype(np.int64)
    salt = np.zeros(len(lines), np.int64)
    for i in np.flatnonzero(salts > 1).tolist():
        salt[i] = zlib.crc32(lines[i]) % salts[i]
    order = np.lexsort((salt, pivots))
    pivots, salts, salt = pivots[order], salts[order], salt[order]
    new = np.flatnonzero(np.concatenate([[True], (pivots[1:] != pivots[:-1]) | (salt[1:] != salt[:-1])])[: len(lines)])
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))[order])])
    text = b"".join([lines[i] for i in order.tolist()])
    bounds = np.append(new, len(lines))
    columns = [pa.array([lang] * len(new), pa.string()), pa.array(pivots[new]), pa.array(salt[new], pa.int32()), pa.array(salts[new], pa.int32())]
    columns += [_binary(ends[bounds], text), _binary(8 * bounds, weights[order].astype("<i8").tobytes())]
    rows = pa.RecordBatch.from_arrays(columns, schema=_FRAGMENTS)
    for i in range(0, len(new), 20_000):
        yield rows.slice(i, 20_000)


def _routed(order_of: Order, unit: float, held: int = 600_000):
    """Fragments of each task, counted, by pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, _Keys] = {}
        counts: dict[tuple[str, int], Counter[bytes]] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang in sorted({lang for lang, _ in counts}):
                lines: list[bytes] = []
                pivots: list[np.ndarray] = []
                weights: list[np.ndarray] = []
                own = keys[lang]
                for k in range(LONGEST):
                    c, mark = counts[lang, k], b"%d" % k
                    lines += [mark + f + b"\n" for f in c]
                    pivots.append(np.fromiter((own[f.split(b" ", k + 1)[k]] for f in c), np.int64, len(c)))
                    weights.append(np.fromiter(c.values(), np.int64, len(c)))
                yield from _grouped(lang, lines, np.concatenate(pivots), np.concatenate(weights), order_of, unit)
            counts.clear()

        for batch in batches:
            for lang, text in _by_lang(batch):
                if lang not in keys:
                    keys[lang] = _Keys(lang, order_of)
                for k, found in _fragments(text, keys[lang]):
                    counts[lang, k].update(found)
                if sum(map(len, counts.values())) > held:
                    yield from flushed()
        yield from flushed()

    return run


def _spans(at: int, n: int) -> list[tuple[int, int]]:
    """The phrases around place ``at`` of a fragment of ``n`` words."""
    return [(i, j) for i in range(at + 1) for j in range(max(at + 1, i + 2), min(n, i + LONGEST) + 1)]


_SPANS = {(at, n): _spans(at, n) for n in range(2, 2 * LONGEST) for at in range(LONGEST) if at < n}


def _owned(lines: list[bytes], weights: list[int], least: int) -> Iterator[tuple[bytes, int]]:
    """Phrases of a pivot with ``least`` occurrences or more among these fragments.

    First the pairs with either neighbour; a longer phrase has one of them or both, so fragments are
    cut where the pair is rare.
    """
    if sum(weights) < least:
        return
    pairs: dict[bytes, int] = defaultdict(int)
    if least > 1:
        for line, n in zip(lines, weights, strict=True):
            at, words = line[0] - 48, line[1:].split(b" ")
            if at:
                pairs[b" ".join(words[at - 1 : at + 1])] += n
            if at + 1 < len(words):
                pairs[b" ".join(words[at : at + 2])] += n
        if all(n < least for n in pairs.values()):
            return
    counts: dict[bytes, int] = defaultdict(int)
    for line, n in zip(lines, weights, strict=True):
        at, words = line[0] - 48, line[1:].split(b" ")
        if least > 1:
            if at + 1 < len(words) and pairs[b" ".join(words[at : at + 2])] < least:
                words = words[: at + 1]
            if at and pairs[b" ".join(words[at - 1 : at + 1])] < least:
                words, at = words[at:], 0
            if len(words) == 1:
                continue
        for i, j in _SPANS[at, len(words)]:
            counts[b" ".join(words[i:j])] += n
    for phrase, n in counts.items():
        if n >= least:
            yield phrase, n


def _mined(least: int, held: int = 400_000):
    """Phrases of each pivot. A pivot that is whole in one partition gives those with ``least`` occurrences alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, bytes, int]] = []
        now, whole = None, True
        lines: list[bytes] = []
        weights: list[int] = []

        def close(complete: bool) -> None:
            out.extend((now[0], p, n) for p, n in _owned(lines, weights, least if complete else 1))
            lines.clear()
            weights.clear()

        for batch in batches:
            for lang, pivot, salt, salts, fragments, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (lang, pivot, salt):
                    if now:
                        close(whole)
                    now, whole = (lang, pivot, salt), salts == 1
                lines += fragments.split(b"\n")[:-1]
                weights += np.frombuffer(n, "<i8").tolist()
                if len(lines) > held:
                    close(False)
                    whole = False
                if len(out) > 50_000:
                    yield _rows(list(zip(*out, strict=True)), _PHRASES)
                    out.clear()
        if now:
            close(whole)
        yield _rows(list(zip(*out, strict=True)) or [[]] * 3, _PHRASES)

    return run


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def phrase_counts(docs: DataFrame, least: int = 30, cells: int = 1 << 22, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, word, f`` of all words and ``lang, phrase, a`` of the phrases of two to four words with ``least`` occurrences."""
    texts = _texts(docs, text_col, lang_col)
    spark: SparkSession = docs.sparkSession
    words = materialise(word_counts(texts).select("lang", F.col("word").cast("string").alias("word"), "h", "f"), "words")
    order = Order(words, least, cells)
    total = words.agg(F.sum("f")).first()[0] or 0
    # a quarter of the mean load of a partition, so that split words spread evenly
    unit = max(5_000, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "lang string, pivot long, salt int, salts int, fragments binary, weights binary"
    routed = small_batches(texts).mapInArrow(_routed(order, unit), schema)
    mined = (
        routed.repartition("lang", "pivot", "salt")
        .sortWithinPartitions("lang", "pivot", "salt")
        .mapInArrow(_mined(least), "lang string, phrase binary, a long")
    )
    counted = mined.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words.select("lang", "word", "f"), materialise(counted, "phrases")


def _ratio(a: Column, b: Column) -> Column:
    """``floor(2000000 * a / b)`` in decimals of 38 digits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(19,0)"), b.cast("decimal(20,0)"))


def collocations(
    docs: DataFrame,
    least: int = 30,
    top: int = 2000,
    cells: int = 1 << 22,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Of each language the first ``top`` phrases by score: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's number of occurrences, ``l`` and ``r`` those of its two parts at the cut with the lowest
    score (of equal ones the earliest), ``n`` that of all words of the language, ``score`` ``floor(2000000 a / (l + r))``. A phrase
    inside a longer one with at least four fifths of its occurrences is left out. Null texts are empty, a null language is
    ``und``; rows count as often as they occur, whatever their ids. A table without phrases gives no rows. Other columns,
    whatever their names, are ignored.
    """
    words, phrases = phrase_counts(docs, least, cells, text_col, lang_col)
    known = materialise(words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.col("f").alias("a")).unionByName(phrases), "known")
    w = F.split("phrase", " ", -1)
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("rest"))
    split = phrases.withColumn("w", w)
    cuts = split.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), cut)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = (
        cuts.join(part("first", "l"), ["lang", "first"])
        .join(part("rest", "r"), ["lang", "rest"])
        .withColumn("score", _ratio(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r")))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
        .select("lang", "phrase", "best.*")
    )
    inside = split.where(F.size("w") > 2).select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.size("w") - 1),
                    lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")),
                )
            )
        ).alias("phrase"),
    )
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hundred = lambda c, n: F.col(c).cast("decimal(19,0)") * n
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (hundred("longer", 100) < hundred("a", 80)))
    kept = materialise(kept.select("lang", "phrase", "a", "l", "r", "score"), "scored")
    first = _first(kept, top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _limits(rows: DataFrame, key: str, need: str) -> DataFrame:
    """``lang, limit, need``: the value of ``key`` at which each language has its ``need`` rows, and how many of those with it are still needed.

    The list of a language's values is bounded: scores are whole numbers up to 1,000,000, and of numbers of occurrences
    that differ there are less than twice the root of their sum.
    """
    listed = (
        rows.groupBy("lang", key, need)
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("lang", need)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("v"), "m")), False).alias("s"))
    )
    step = lambda x, y: F.when(x["left"] <= x["m"], x).otherwise(F.struct((x["left"] - x["m"]).alias("left"), y["m"].alias("m"), y["v"].alias("v")))
    zero = F.lit(0).cast("long")
    start = F.struct(F.col(need).alias("left"), zero.alias("m"), zero.alias("v"))
    # "left" is what is needed from the value "v" on, which "m" rows have
    return listed.withColumn("x", F.aggregate("s", start, step)).select("lang", F.col("x.v").alias("limit"), F.col("x.left").alias("need"))


def _first(kept: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their ranks.

    The score that still gets in is found by counting, then the number of occurrences among those with just this
    score; those that have both alike, which may be many, first find their best in each of 64 parts.
    """
    by_score = _limits(kept.withColumn("__top", F.lit(top).cast("long")), "score", "__top")
    able = kept.join(by_score, "lang").where("score >= limit")
    even = able.where("score = limit").select("lang", "phrase", "a", "l", "r", "score", "need")
    by_count = _limits(even, "a", "need")
    even = even.drop("need").join(by_count, "lang").where("a >= limit")
    ties = even.where("a = limit").withColumn("place", F.expr("row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), 64) ORDER BY phrase)"))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    found = able.where("score > limit").select(columns).unionByName(even.where("a > limit").select(columns)).unionByName(ties.where("place <= need").select(columns))
    rank = F.expr("cast(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS long)")
    return found.withColumn("rank", rank).where(F.col("rank") <= top)

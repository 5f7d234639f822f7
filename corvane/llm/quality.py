"""Quality scores by Bradley-Terry ranking from preference pairs.

A pair is a labelled good and a labelled poor document; the chance that the first is
preferred is the logistic function of the difference of their scores, and a score is a
weighted sum of features. So the weights come from logistic loss on feature differences.
Features describe the whole text: shares of character classes, repetition of words and
lines, word shapes. The accepted documents are those above a quantile of the scores of
the whole table. The quantile's level is the share of poor documents, as estimated from all
labelled rows less one standard error: a good document lost is worse than a poor one kept.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise, small_batches
from corvane.llm.toxicity import bounded_labels

#: Byte classes: 1 lower case or part of a non-ASCII character, 2 upper case, 3 digit,
#: 4 white space, 5 common punctuation, 6 other symbols.
_CLASS = bytes(
    1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in b" \t\r\n\f\v"
    else 5 if b in b".,;:'\"-()?" else 6
    for b in range(256)
)

FEATURES = (
    "log_words", "upper", "digit", "punct", "symbol", "bang", "pipe", "mean_word", "distinct", "top_word", "repeats",
    "line_repeats", "line_length", "symbol_words", "upper_words", "compressed", "long_words", "window_distinct", "run_words",
)


def text_features(text: str | None) -> np.ndarray:
    """The values of ``FEATURES`` for a whole text; zeros for a null or empty one."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(np.frombuffer(raw.translate(_CLASS), dtype=np.uint8), minlength=7) / n
    words = raw.split()
    m = max(1, len(words))
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    same = sum(c - 1 for c in Counter(lines).values())
    symbol = sum(c for w, c in count.items() if w[-1:] in b"!#$%&*@^~|+=<>" or w[:1] in b"#$%&*@^~|+=<>")
    upper = sum(c for w, c in count.items() if len(w) > 1 and w.isupper())
    window = [len(set(words[i : i + 50])) / len(words[i : i + 50]) for i in range(0, len(words), 50)]
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[:] = (
        np.log1p(m), kinds[2], kinds[3], kinds[5], kinds[6], raw.count(b"!") / m, raw.count(b"|") / m, min(20.0, n / m),
        len(count) / m, max(count.values(), default=0) / m, 1 - len(count) / m if m > 20 else 0.0, same / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), symbol / m, upper / m, len(zlib.compress(raw, 1)) / (n + 20),
        sum(c for w, c in count.items() if len(w) > 25) / m, min(window, default=0.0), runs / m,
    )
    return out


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    level: float  # of the quantile

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with soft thresholds either side of the middle."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.maximum(z - 0.5, 0), np.maximum(z - 2, 0), np.maximum(-z - 0.5, 0), np.maximum(-z - 2, 0)], axis=-1)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, steps: int = 400, rate: float = 0.05, l2: float = 1e-4, seed: int = 5) -> Ranking:
    """Weights from ``pairs`` sampled preference pairs, by Adam steps on logistic loss."""
    k = len(FEATURES)
    level = poor_level(int((~good).sum()), len(good))
    if level in (0.0, 1.0) or good.all():
        return Ranking(np.zeros(k), np.ones(k), np.zeros(5 * k), level)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expand((x - mean) / scale)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        at = rng.integers(0, pairs, 4096)
        g = gradient(w, z[a[at]] - z[b[at]], l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ranking(mean, scale, w, level)


def gradient(w: np.ndarray, d: np.ndarray, l2: float) -> np.ndarray:
    """Of the mean logistic loss of pairs with feature differences ``d``, and of ``l2 / 2 * |w|**2``."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
    return -(d * (1 - p)[:, None]).mean(axis=0) + l2 * w


def poor_level(poor: int, rows: int) -> float:
    """The share of poor rows less its standard error, 0 at least."""
    share = poor / max(rows, 1)
    return max(0.0, share - (share * (1 - share) / max(rows, 1)) ** 0.5)


def _featurised(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [text_features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(xs, pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    return small_batches(rows).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, seed: int = 3) -> Ranking:
    """Fits on at most ``sample_rows`` rows of ``labels`` (``doc_id``, ``label`` 1 for good); the quantile's level comes from all.

    Rows with a null label or id are left out. Without labels of both kinds all texts score alike.
    """
    found = _featurised(bounded_labels(docs, labels, sample_rows, seed))
    # an id that many documents share brings them all
    found = found.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "label", "x").limit(sample_rows)
    rows = sorted((r.doc_id, r.label, tuple(r.x)) for r in found.collect())
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
    ranking = fit(x, np.array([r[1] == 1 for r in rows], dtype=bool))
    poor, every = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").agg(F.count_if(F.col("label") != 1), F.count(F.lit(1))).first()
    return replace(ranking, level=poor_level(poor, every))


def raw_scores(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id, raw``: the unbounded ranking score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [text_features(t) for t in b.column(1).to_pylist()]
            raw = ranking.raw(np.array(xs)) if xs else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.float64())], ["doc_id", "raw"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, raw double")


def quantile(values: DataFrame, level: float, bins: int = 4096, rounds: int = 4) -> float:
    """The least value with at least ``level`` of all rows of the one column below it, to a part in ``bins ** rounds`` of their range.

    Rows are counted in equal ranges, and again in the range where the quantile lies, so that no
    task and not the driver ever holds more than ``bins`` counts. 0 for an empty table.
    """
    x = F.col(values.columns[0])
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return 0.0
    below, want = 0, level * n
    for _ in range(rounds):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int").alias("b")
        inside = values.where((x >= low) & (x <= high)).groupBy(at).count()
        for b, count in sorted((r.b, r["count"]) for r in inside.collect()):
            if below + count > want:
                break
            below += count
        low, high = low + b * width, min(high, low + (b + 1) * width)
    return float(low)


def score(docs: DataFrame, ranking: Ranking, cut: float = 0.7) -> DataFrame:
    """``doc_id, score`` in 0 to 1 per row; the quantile of the whole table lies at ``cut``.

    Null and empty texts are scored by the features of an empty text. Rows that repeat an id
    are scored one by one. An empty table gives no rows.
    """
    raw = materialise(raw_scores(docs, ranking), "raw")
    low = quantile(raw.select("raw"), ranking.level)
    spread = max(raw.agg(F.stddev_pop("raw")).first()[0] or 0.0, 1e-9)
    at = float(np.log(cut / (1 - cut)))
    x = (F.col("raw") - F.lit(low)) * F.lit(4.0 / spread) + F.lit(at)
    return raw.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))).alias("score"))


def quality_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: CRC-32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select(
        "doc_id", F.col("quality").cast("int").alias("label")
    )

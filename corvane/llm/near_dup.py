"""Self-join of documents on the Jaccard similarity of their word five-grams.

1. Each text becomes a set of hashed five-word shingles and a MinHash signature. Documents
   with equal sets form a class and only one of them goes on, so copies are never paired.
2. Bands of the signature put representatives into buckets. Buckets of one are dropped, and
   so are those with the same members as another.
3. Within a bucket, signatures are compared a step at a time. After each step the posterior
   probability that the similarity reaches the threshold is looked up, and the pair is
   dropped once that is below a tolerance. What is left is verified on the whole sets.
4. A task gives out link counts and a spanning tree of what it linked, not the pairs, so
   its output is linear in its input. A bucket above ``block`` members is dealt out as
   pairs of blocks. A pair that shares several buckets is handled in the first of them only.
5. Near-duplicate classes are the connected components of those trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Sketch, WordHash, drop_rows, materialise, mix64, small_batches, words_of

NGRAM = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
STEP = 32
TOLERANCE = 1e-6

_P = np.uint64(0x9E3779B97F4A7C15)


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7919)
    return r.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def shingles(words: list[bytes], seen: WordHash, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words, but not none, is one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = seen.array(words)
    n = min(n, len(h))
    m = len(h) - n + 1
    acc = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        acc = acc * _P + h[j : j + m]
    return np.unique(mix64(acc))


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash of a set that isn't empty, 32 bits for each permutation."""
    low = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(sh), 1024):
        part = sh[i : i + 1024]
        x = (part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)
        np.minimum(low, x.min(axis=1).astype(np.uint32), out=low)
    return low


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each signature (a row) one key per band, the band's number in its upper bits."""
    parts = sigs[:, : bands * rows].reshape(len(sigs), bands, rows).astype(np.uint64)
    acc = np.zeros((len(sigs), bands), dtype=np.uint64)
    for j in range(rows):
        acc = mix64(acc * _P + parts[:, :, j] + np.uint64(1))
    return ((np.arange(bands, dtype=np.uint64) << np.uint64(57)) | (acc >> np.uint64(7))).astype(np.int64)


def needed_matches(k: int, step: int, threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with P(similarity >= threshold) >= tolerance.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1), whose upper tail is a
    binomial sum.
    """

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(0, m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(step, k + 1, step)}


def link_bucket(
    key: int,
    reps: np.ndarray,
    block: np.ndarray,
    crossing: bool,
    keys: np.ndarray,
    sigs: np.ndarray,
    sets: list[np.ndarray],
    threshold: float,
    needed: dict[int, int],
) -> list[tuple[int, np.ndarray]]:
    """Links found in one bucket or pair of blocks: place, places of its partners after it."""
    n = len(reps)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    present = np.zeros(len(flat), dtype=np.int32)
    band = key >> 57
    out = []
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        if crossing:
            js = js[block[js] != block[i]]
        # a set of too different a size can't be similar enough
        js = js[np.minimum(sizes[js], sizes[i]) >= threshold * np.maximum(sizes[js], sizes[i]) - 1e-9]
        if not len(js):
            continue
        if band:
            common = (keys[js, :band] == keys[i, :band]) & (keys[i, :band] != 0)
            js = js[~common.any(axis=1)]
        m = np.zeros(len(js), dtype=np.int64)
        for at, least in needed.items():
            m += (sigs[js, at - STEP : at] == sigs[i, at - STEP : at]).sum(axis=1)
            keep = m >= least
            js, m = js[keep], m[keep]
            if not len(js):
                break
        if not len(js):
            continue
        mine = ids[begins[i] : ends[i]]
        present[mine] = 1
        if len(js) * 4 > n - i:  # most of what follows: one pass over it all
            all_after = np.add.reduceat(present[ids[begins[i + 1] :]], begins[i + 1 :] - begins[i + 1])
            both = all_after[js - i - 1]
        else:
            both = np.array([present[ids[begins[j] : ends[j]]].sum() for j in js])
        present[mine] = 0
        js = js[both >= threshold * (sizes[js] + sizes[i] - both) - 1e-9]
        if len(js):
            out.append((i, js))
    return out


def _set_id(sh: np.ndarray) -> bytes:
    return hashlib.blake2b(sh.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, cls, bands`` per row; ``cls`` is null for texts without words."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        a, b = _permutations(k)
        for batch in batches:
            sets = [shingles(words_of(t), seen) for t in batch.column(2).to_pylist()]
            cls = [_set_id(sh) if len(sh) else None for sh in sets]
            of_all = iter(band_keys(np.array([signature(sh, a, b) for sh in sets if len(sh)]).reshape(-1, k), bands, rows))
            keys = [next(of_all) if len(sh) else None for sh in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "cls", "bands"],
            )

    text = F.col(text_col).cast("string")
    rows_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return small_batches(rows_of).mapInArrow(run, "doc_id long, text_hash long, cls binary, bands array<long>")


def _whole(texts: DataFrame, k: int) -> DataFrame:
    """``cls, sig, sh`` per row of ``texts`` (one column) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        a, b = _permutations(k)
        for batch in batches:
            sets = [sh for sh in (shingles(words_of(t), seen) for t in batch.column(0).to_pylist()) if len(sh)]
            columns = ([_set_id(sh) for sh in sets], [signature(sh, a, b).tobytes() for sh in sets], [sh.tobytes() for sh in sets])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["cls", "sig", "sh"])

    return small_batches(texts).mapInArrow(run, "cls binary, sig binary, sh binary")


class NearDuplicates:
    """The join over one table. Rows without an id or without words link to nothing and are classes
    of their own. Rows that repeat an id count as rows, whether their texts are the same or not. Columns
    other than the two named are ignored. An empty table gives empty results.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        threshold: float = THRESHOLD,
        bands: int = BANDS,
        rows: int = ROWS,
        block: int = 512,
        tolerance: float = TOLERANCE,
    ):
        self.threshold, self.bands, self.rows, self.block = threshold, bands, rows, block
        self.tolerance = tolerance
        self.signed = materialise(_signed(docs, id_col, text_col, bands, rows), "signed")
        #: node, cls, rep (the smallest id of the class), copies, bands
        self.classes = materialise(
            self.signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
            .groupBy("cls")
            .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
            .withColumn("node", F.monotonically_increasing_id()),
            "classes",
        )
        self.members = self._members()
        needy = Sketch(self.members.select(F.xxhash64("rep")))
        texts = docs.select(F.xxhash64(F.col(id_col).cast("long")).alias("__h"), F.col(text_col).cast("string").alias("text"))
        self.whole = _whole(needy.flag(texts, "__h", "__in").where("__in").select("text"), bands * rows)

    def _members(self) -> DataFrame:
        """``node, cls, rep, keys``: the buckets worth looking at, each with its size, per class."""
        dealt = self.classes.select("node", F.explode("bands").alias("key"))
        buckets = (
            dealt.groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.expr("bit_xor(xxhash64(node))").alias("all"))
            .where("n > 1")
            .groupBy("n", "low", "all")
            .agg(F.min("key").alias("key"))
            .select("key", "n")
        )
        buckets = materialise(buckets, "buckets")
        hit = Sketch(buckets.select(F.xxhash64("key"))).flag(dealt.withColumn("__h", F.xxhash64("key")), "__h", "__in")
        members = (
            hit.where("__in")
            .select("node", "key")
            .join(buckets.repartition(F.hash("key")), "key")
            .groupBy("node")
            .agg(F.array_sort(F.collect_set(F.struct("key", "n"))).alias("keys"))
            .join(self.classes.select("node", "cls", "rep"), "node")
        )
        return materialise(members, "members")

    def _grouped(self):
        """Rows of each bucket, dealt by bucket and pair of blocks."""
        # rows of one class have the same set, so any of them will do
        rows = self.whole.dropDuplicates(["cls"]).join(self.members, "cls")
        blocks = F.ceil(F.col("b.n") / F.lit(self.block)).cast("int")
        return (
            rows.select("node", "sig", "sh", F.col("keys.key").alias("keys"), F.explode("keys").alias("b"))
            .select(
                "node", "sig", "sh", "keys", F.col("b.key").alias("key"), blocks.alias("nb"),
                F.pmod(F.xxhash64("node"), blocks).cast("int").alias("mine"),
            )
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .withColumn("i", F.least("mine", "other"))
            .withColumn("j", F.greatest("mine", "other"))
            .drop("nb", "other")
            .groupBy("key", "i", "j")
        )

    def _linked(self):
        threshold, bands = self.threshold, self.bands
        needed = needed_matches(bands * self.rows, STEP, threshold, self.tolerance)

        def run(df: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
            df = df.sort_values("node")
            n = len(df)
            keys = np.zeros((n, bands), dtype=np.int64)
            for r, own in enumerate(df["keys"]):
                own = np.asarray(own, dtype=np.int64)
                keys[r, own >> 57] = own
            sigs = np.stack([np.frombuffer(x, dtype=np.uint32) for x in df["sig"]])
            sets = [np.frombuffer(x, dtype=np.uint64) for x in df["sh"]]
            crossing = bool(df["i"].iloc[0] != df["j"].iloc[0])
            nodes = df["node"].to_numpy()
            return nodes, link_bucket(
                int(df["key"].iloc[0]), nodes, df["mine"].to_numpy(), crossing, keys, sigs, sets, threshold, needed
            )

        return run

    def pairs(self) -> DataFrame:
        """All links ``a < b`` between representatives. Quadratic in the size of a group: for
        small tables; :meth:`links` has the same links as counts and trees."""
        find = self._linked()

        def run(df: pd.DataFrame) -> pd.DataFrame:
            nodes, links = find(df)
            rows = [(nodes[i], nodes[j]) for i, js in links for j in js]
            return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

        found = self._grouped().applyInPandas(run, "a long, b long")
        for end in ("a", "b"):
            found = found.join(self.classes.select(F.col("node").alias(end), F.col("rep").alias(f"rep_{end}")), end)
        return found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))

    def links(self) -> DataFrame:
        """``node, n, root``: links found in one bucket, and the smallest node reached there."""
        find = self._linked()

        def run(df: pd.DataFrame) -> pd.DataFrame:
            nodes, links = find(df)
            count = np.zeros(len(nodes), dtype=np.int64)
            parent = list(range(len(nodes)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, js in links:
                count[i] += len(js)
                count[js] += 1
                for j in js:
                    a, b = root(i), root(int(j))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            at = np.flatnonzero(count)
            return pd.DataFrame(
                {"node": nodes[at], "n": count[at], "root": [nodes[root(int(x))] for x in at]},
            ).astype("int64")

        return self._grouped().applyInPandas(run, "node long, n long, root long")

    def result(self) -> DataFrame:
        """``doc_id, text_hash, class_id, rep_id, n_links, n_copies, kept`` per row.

        ``class_id``: smallest id of the near-duplicate class; ``rep_id``: smallest id with an
        equal set of shingles; ``n_links``: other sets that are similar; ``n_copies``: rows
        with the same set; ``kept``: whether the row is the class's one document, that of the smallest
        id (repeats of that row are kept with it). If an id is repeated with different texts, classes may share a
        number, but ``kept`` goes by the texts. ``text_hash`` tells such rows apart.
        """
        links = materialise(self.links(), "links")
        component = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        per = links.groupBy("node").agg(F.sum("n").alias("n_links"))
        linked = component.join(self.classes.select("node", "rep"), "node")
        # dealt by another column, so that the planner can split the partition of a large class
        tops = linked.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("top")).repartition(F.col("top.node"))
        placed = component.join(tops, "label").join(per, "node").select(
            "node", "n_links", F.col("top.rep").alias("class_id"), (F.col("top.node") == F.col("node")).alias("first")
        )
        known = (
            self.classes.select("node", "cls", "rep", "copies")
            .join(placed, "node", "left")
            .select(
                F.col("cls").alias("c2"),
                "rep",
                "copies",
                F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.coalesce("class_id", "rep").alias("class_id"),
                F.coalesce("first", F.lit(True)).alias("first"),
            )
            .repartition("rep")
        )
        alone = F.concat(F.lit("none-").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        key = F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", alone)).otherwise(alone)
        return self.signed.select("doc_id", "text_hash", key.alias("c")).join(known, F.col("c") == F.col("c2"), "left").select(
            "doc_id",
            "text_hash",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("rep", "doc_id").alias("rep_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
            F.coalesce(F.col("first") & (F.col("rep") == F.col("doc_id")), F.lit(True)).alias("kept"),
        )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node each node of ``edges`` (``a``, ``b``) is connected to.

    Labels spread along edges and then jump to the label of their label, so the number of
    rounds grows with the logarithm of a component's width. Only a count reaches the driver.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialise(both.union(both.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = materialise(labels.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = step.join(jump, step["label"] == jump["n2"], "left").select(
            "node", "was", F.least("label", F.coalesce("l2", "label")).alias("label")
        )
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).result().drop("text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of smallest id of each near-duplicate class; columns as they were.

    Rows without an id, and null, empty and other texts without words, stay; so do repeats of a kept
    row. Of rows that repeat an id with different texts each goes by its own text. An empty
    table gives no rows.
    """
    found = NearDuplicates(docs, id_col, text_col).result()
    return drop_rows(docs, found.where("NOT kept").select("doc_id", "text_hash"), id_col, text_col)

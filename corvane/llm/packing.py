"""Hierarchical residual packing of tokenised documents into sequences of fixed length.

Each partition tokenises its documents, cuts those longer than a sequence, and packs the
pieces best-fit, longest first. Bins that are full but for ``slack`` tokens are sealed and
given out. The others are the items of the next round, where those of several partitions meet and are
packed best-fit as wholes, and so on up a tree. Bins that are underfull at its root, for what
happened to meet in a small partition is tied together in them, are opened in one repair round,
which packs their pieces best-fit anew. Only numbers and sizes travel up the tree; a task gets at
most about ``max_items`` of them, however large the table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise, small_batches

END_ID = 2
LENGTH = 1024
#: Texts of these characters only split into pre-tokens alike in both tokeniser libraries.
_PLAIN = re.compile(r"[\n\r\t -~¡-¬®-ɏ‐-‧]*")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Token ids of texts, as the ``tokenizers`` library gives them for the JSON file.

    Where a tiktoken file with the same vocabulary lies beside it, plain texts are encoded with
    that, for it is several times faster and gives the same ids. A text with a character
    outside ``_PLAIN``, or with what may be a special token, always takes the first way.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole sequences at the end, the rest first."""
    n = len(ids)
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))] if n > length else [(0, n)]


class Bins:
    """Best-fit packing: an item goes where it leaves the least room."""

    def __init__(self, length: int):
        self.length = length
        self.open: list[list[int]] = [[] for _ in range(length + 1)]  # bins by room left
        self.mask = 0  # bit r: some bin has room r
        self.items: list[list[tuple[int, int]]] = []  # per bin: item, offset
        self.fill: list[int] = []

    def put(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = self.open[room].pop()
            if not self.open[room]:
                self.mask &= ~(1 << room)
        else:
            b, room = len(self.fill), self.length
            self.fill.append(0)
            self.items.append([])
        self.items[b].append((item, self.fill[b]))
        self.fill[b] += size
        left = room - size
        if left:
            self.open[left].append(b)
            self.mask |= 1 << left


def best_fit(sizes: np.ndarray, length: int) -> Bins:
    """Longest first; equal sizes in the order given."""
    bins = Bins(length)
    for i in np.argsort(-sizes, kind="stable"):
        bins.put(int(i), int(sizes[i]))
    return bins


_PIECE = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
)
_PIECE_SQL = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"


def _local(docs: DataFrame, tokenizer: str, length: int, end_id: int, slack: int, flush: int) -> DataFrame:
    """``bin, part, size, sealed, pieces`` of each partition's own packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = Tokens(tokenizer)
        made = 0
        waiting: list[tuple] = []

        def give(rows: list[tuple[int, list[dict]]]) -> pa.RecordBatch:
            nonlocal made
            n = len(rows)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made + k for k in range(n)], pa.int64()),
                    pa.array([part] * n, pa.int32()),
                    pa.array([size for size, _ in rows], pa.int32()),
                    pa.array([size >= length - slack for size, _ in rows], pa.bool_()),
                    pa.array([p for _, p in rows], pa.list_(_PIECE)),
                ],
                ["bin", "part", "size", "sealed", "pieces"],
            )
            made += n
            return out

        def row(x: tuple, offset: int) -> dict:
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "offset"), (*x, offset), strict=True))

        def packed() -> pa.RecordBatch:
            bins = best_fit(np.array([x[3] for x in waiting], dtype=np.int64), length)
            rows = [(fill, [row(waiting[i], o) for i, o in items]) for fill, items in zip(bins.fill, bins.items, strict=True)]
            waiting.clear()
            return give(rows)

        for batch in batches:
            full = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.ids(text), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces(ids, length)):
                    x = (doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))
                    if n == length:
                        full.append((n, [row(x, 0)]))
                    else:
                        waiting.append(x)
            if full:
                yield give(full)
            if len(waiting) >= flush:
                yield packed()
        if waiting:
            yield packed()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"bin long, part int, size int, sealed boolean, pieces array<{_PIECE_SQL}>"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    slack: int = 4,
    fan: int = 16,
    max_items: int = 200_000,
    repair: bool = True,
) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the path of a ``tokenizers`` file that all executors can read. A null
    or empty text is the end id alone. Rows are packed one by one, so those that repeat an
    id, or have none, are packed as well. An empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` are ignored. Without ``repair`` the underfull bins of the tree's root stay as
    they are.
    """
    local = materialise(_local(docs, tokenizer, length, end_id, slack, max_items), "packed")
    # a row for each local bin: the bin it now lies in (its head) and where
    items = local.where("NOT sealed").select("bin", "part", "size", F.col("bin").alias("head"), F.lit(0).alias("base"))
    parts, count = local.agg(F.max("part") + 1, F.count_if(~F.col("sealed"))).first()
    parts, placed = parts or 1, None

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        held = df.groupby("head")["size"].sum().reset_index().sort_values(["size", "head"], ascending=[False, True])
        heads = held["head"].to_numpy()
        bins = best_fit(held["size"].to_numpy(dtype=np.int64), length)
        moved = pd.DataFrame(
            [(heads[i], heads[inside[0][0]], offset, fill) for fill, inside in zip(bins.fill, bins.items, strict=True) for i, offset in inside],
            columns=["head", "to", "offset", "fill"],
        )
        out = df.merge(moved, on="head")
        out["base"] += out["offset"]
        return out.assign(head=out["to"])[["bin", "part", "size", "head", "base", "fill"]]

    while True:
        # fewer tasks each round, but none with more than about max_items
        after = max(1, -(-parts // fan), -(-count // max_items))
        last = after == 1 or after >= parts
        dealt = items.withColumn("part", F.expr(f"cast(part % {after} as int)"))
        merged = materialise(
            dealt.groupBy("part").applyInPandas(merge, "bin long, part int, size int, head long, base int, fill int"), "merged"
        )
        done = merged if last and not repair else merged.where(F.col("fill") >= length - slack)
        done = done.select(F.col("bin").alias("b2"), "head", "base")
        placed = done if placed is None else placed.unionByName(done)
        items = merged.where(F.col("fill") < length - slack).select("bin", "part", "size", "head", "base")
        if last:
            break
        parts, count = after, items.count()

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = local.where("sealed").select(F.inline("pieces"), F.col("bin").alias("sequence_id")).select(*columns)
    loose = local.where("NOT sealed").select("bin", "pieces")
    whole = loose.join(placed, F.col("bin") == F.col("b2")).select(F.inline("pieces"), F.col("head").alias("sequence_id"), "base")
    out = out.unionByName(whole.withColumn("offset", F.col("offset") + F.col("base")).select(*columns))
    if not repair:
        return out
    opened = materialise(
        loose.join(items.select(F.col("bin").alias("b2")), F.col("bin") == F.col("b2")).select("bin", F.posexplode("pieces").alias("k", "p")), "opened"
    )
    tasks = max(1, -(-opened.count() // max_items))

    def refit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["n", "bin", "k"], ascending=[False, True, True])
        number, k = df["bin"].to_numpy(), df["k"].to_numpy()
        bins = best_fit(df["n"].to_numpy(dtype=np.int64), length)
        # a bin has fewer pieces than a sequence tokens, so these numbers are its first piece's own
        rows = [
            (number[i], k[i], -int(number[inside[0][0]]) * (length + 1) - int(k[inside[0][0]]) - 1, at) for inside in bins.items for i, at in inside
        ]
        return pd.DataFrame(rows, columns=["b3", "k3", "seq", "at"]).astype("int64")

    sizes = opened.select("bin", "k", F.col("p.length").alias("n"), F.pmod(F.xxhash64("bin", "k"), F.lit(tasks)).alias("task"))
    again = materialise(sizes.groupBy("task").applyInPandas(refit, "b3 long, k3 int, seq long, at long"), "repaired")
    repaired = opened.join(again, (F.col("bin") == F.col("b3")) & (F.col("k") == F.col("k3"))).select("p.*", "seq", "at")
    return out.unionByName(repaired.withColumn("sequence_id", F.col("seq")).withColumn("offset", F.col("at")).select(*columns))

"""Texts put together into containers of a fixed number of tokens.

1. Tokens of each text are counted once for all capacities; a text is cut into byte-pair pieces array-wise and only
   pieces not met before go through the tokenizer, which gives the tokenizer's own count.
2. The global histogram of lengths (at most one entry for each length up to the capacity) goes to the driver. Dynamic
   programming chooses bucket boundaries that minimise the padding from each length to its bucket's upper end.
3. Token-budget batches are formed on the histogram: the batch of a bucket takes as many of its items as the budget
   holds, and the budget left over is given to the next smaller bucket that fits, so a long item's rest is used by
   batches of shorter ones. The plan has runs of equal containers and stays small however many items there are.
4. Each item finds its container from its rank in its bucket. Ranks come from counts of hashed groups, so no bucket is
   ever sorted in one task, and no text is moved.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import scan
from leafmill.sources.tables import settle

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pattern of the public byte-pair tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets of lengths for each capacity.
BUCKETS = 96
#: Rows of one hashed group in which ranks are given out.
GROUP_ROWS = 20_000
_KNOWN_PIECES = 400_000


def encoding(path: str):
    """The byte-pair tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Tokens of many texts at once; counts of pieces are kept, up to a fixed number of them."""

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.keys, self.values = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, tokens) of the byte-pair pieces of one text."""
        layout = scan.Layout([text])
        begin, end = scan.byte_pair_pieces(layout)
        return begin, end, self._of(layout, begin, end)

    def counts(self, texts: list[str]) -> np.ndarray:
        layout = scan.Layout(texts)
        begin, end = scan.byte_pair_pieces(layout)
        return np.bincount(layout.owner(begin), weights=self._of(layout, begin, end), minlength=len(texts)).astype(np.int64)

    def _of(self, layout: scan.Layout, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece; only pieces not met before go through the tokenizer."""
        h = layout.hashes(begin, end)
        new, first, at = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, new), max(0, len(self.keys) - 1))
        known = self.keys[place] == new if len(self.keys) else np.zeros(len(new), dtype=bool)
        value = np.zeros(len(new), dtype=np.int32)
        value[known] = self.values[place[known]]
        miss = np.flatnonzero(~known)
        value[miss] = [len(self.encoding.encode_ordinary(layout.text[begin[i] : end[i]])) for i in first[miss]]
        if len(miss):
            if len(self.keys) > _KNOWN_PIECES:
                self.keys, self.values = self.keys[:0], self.values[:0]
            keys = np.concatenate((self.keys, new[miss]))
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate((self.values, value[miss]))[order]
        return value[at.ravel()]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer)
        for batch in batches:
            n = [counter.counts(part) for _, part in scan.slices(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.empty(0, dtype=np.int64))], ["doc_id", "n_tokens"])

    return docs.select(doc_id, text).mapInArrow(count, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens bigint")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper ends of at most ``buckets`` buckets of sorted ``lengths`` with least total padding.

    Dynamic programming over the distinct lengths: cost(i, j) = sum of counts * (lengths[j] - length) for i..j, from
    prefix sums; one array pass for each bucket and end.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    s = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    best = lengths * c[1:] - s[1:]
    back = np.zeros((buckets, n), dtype=np.int32)
    for k in range(1, buckets):
        new = best.copy()
        back[k] = -1
        lo, todo = 0, [(0, n - 1, 0, n - 1)]
        while todo:  # the best last boundary moves to the right with the end: divide and conquer
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            at = a
            if len(i):
                cost = best[i] + lengths[mid] * (c[mid + 1] - c[i + 1]) - (s[mid + 1] - s[i + 1])
                j = int(cost.argmin())
                at = int(i[j])
                if cost[j] < new[mid]:
                    new[mid], back[k, mid] = cost[j], at
            todo += [(lo, mid - 1, a, at), (mid + 1, hi, at, b)]
        best = new
    ends, j, k = [], n - 1, buckets - 1
    while j >= 0:
        ends.append(j)
        while k > 0 and back[k, j] < 0:
            k -= 1
        if k == 0:
            break
        j, k = int(back[k, j]), k - 1
    return lengths[np.array(ends[::-1])]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """(bucket upper ends, runs of batches). A run (bucket, first rank, per container, containers, first container)
    puts items first rank, first rank + 1, ... of the bucket, so many to each of so many containers."""
    if not len(lengths):
        return np.empty(0, dtype=np.int64), []
    bounds = bucket_bounds(lengths, counts, buckets)
    left = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds)).astype(np.int64)
    taken = np.zeros(len(bounds), dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    container = 0
    while left.any():
        b = int(np.flatnonzero(left)[-1])
        budget, shape = capacity, []
        while True:  # batches of the largest bucket that still fits, down to what no bucket fits
            fit = np.flatnonzero((bounds[: b + 1] <= budget) & (left[: b + 1] > 0))
            if not len(fit):
                break
            k = int(fit[-1])
            n = int(min(budget // bounds[k], left[k]))
            shape.append((k, n))
            budget -= n * int(bounds[k])
            b = k - 1
            if b < 0:
                break
        times = min(int(left[k] // n) for k, n in shape)
        for k, n in shape:
            out.append((k, int(taken[k]), n, times, container))
            taken[k] += n * times
            left[k] -= n * times
        container += times
    return bounds, out


def pack(docs: DataFrame, budgets: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "budget_name", capacity: str = "capacity_tokens", tokenizer: str = TOKENIZER, buckets: int = BUCKETS) -> DataFrame:
    """(budget_name, container_id, doc_id, piece_no, start_token, n_tokens): where each text stands.

    A text of at most the capacity is one piece; a longer one becomes full containers and a rest, which is placed like
    any other item. Every text with tokens is placed once for each budget; null and empty texts are left out, and so is
    a null id. Repeated rows of a doc_id count once (its longest text). A budget with a null or non-positive capacity
    is an error. No container exceeds its capacity. The budgets are read to the driver: a handful by their nature.
    """
    spark = docs.sparkSession
    wanted = sorted({(r[0], r[1]) for r in budgets.select(name, capacity).collect()}, key=str)
    if any(c is None or c <= 0 for _, c in wanted):
        raise ValueError("a capacity must be a positive number of tokens")
    sizes = settle(token_counts(docs.where(F.col(doc_id).isNotNull()), doc_id, text, tokenizer).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0"))
    groups = max(1, -(-sizes.count() // GROUP_ROWS))
    id_type = sizes.schema["doc_id"].dataType.simpleString()
    out = None
    for label, cap in wanted:
        rest = F.pmod(F.col("n_tokens") - 1, F.lit(cap)) + 1
        items = sizes.select("doc_id", "n_tokens", rest.cast("int").alias("size"))
        seen = np.array([(r[0], r[1]) for r in items.groupBy("size").count().collect()], dtype=np.int64).reshape(-1, 2)
        seen = seen[np.argsort(seen[:, 0])]
        bounds, batches = plan(seen[:, 0], seen[:, 1], cap, buckets)
        used = max((b[4] + b[3] for b in batches), default=0)
        shared = spark.sparkContext.broadcast((bounds, np.array(batches, dtype=np.int64).reshape(-1, 5)))
        to_bucket = F.array_position(F.transform(F.lit(bounds.tolist()), lambda x: x >= F.col("size")), True) - 1 if len(bounds) else F.lit(0)
        items = items.withColumn("bucket", to_bucket.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
        # rank in the bucket = items in earlier groups + place in the own group; the same for the full pieces
        full = F.floor((F.col("n_tokens") - 1) / F.lit(cap)).cast("bigint")
        items = items.withColumn("full", full)
        group = items.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
        before = Window.partitionBy("bucket").orderBy("part")
        per_bucket = group.groupBy("bucket").agg(F.sum("f").alias("t"))  # at most one row for each bucket
        per_bucket = per_bucket.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("t0"))
        group = group.withColumn("rank0", F.sum("n").over(before) - F.col("n")).withColumn("full0", F.sum("f").over(before) - F.col("f"))
        group = group.join(F.broadcast(per_bucket), "bucket").withColumn("full0", F.col("full0") + F.col("t0"))
        here = Window.partitionBy("bucket", "part").orderBy("size", "doc_id")
        ranked = items.withColumn("r", F.row_number().over(here) - 1).withColumn("fr", F.sum("full").over(here) - F.col("full")).join(group.select("bucket", "part", "rank0", "full0"), ["bucket", "part"])
        ranked = ranked.select("doc_id", "n_tokens", "size", "full", "bucket", (F.col("rank0") + F.col("r")).alias("rank"), (F.col("full0") + F.col("fr")).alias("full_at"))

        def place(batches: Iterator[pa.RecordBatch], shared=shared, cap=cap, used=used) -> Iterator[pa.RecordBatch]:
            _, runs = shared.value
            order = np.lexsort((runs[:, 1], runs[:, 0]))
            runs = runs[order]
            span = np.int64(1) << 40
            key = runs[:, 0] * span + runs[:, 1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                n_tokens, size, full, bucket, rank, full_at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 7))
                run = runs[np.searchsorted(key, bucket * span + rank, "right") - 1]
                box = run[:, 4] + (rank - run[:, 1]) // run[:, 2]
                times = full + 1
                row = np.repeat(np.arange(len(times)), times)
                piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                last = piece == full[row]
                where = np.where(last, box[row], used + full_at[row] + piece)
                yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece * cap), pa.array(np.where(last, size[row], cap))], ["container_id", "doc_id", "piece_no", "start_token", "n_tokens"])

        placed = ranked.mapInArrow(place, f"container_id bigint, doc_id {id_type}, piece_no bigint, start_token bigint, n_tokens bigint").select(F.lit(label).alias("budget_name"), "*")
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        return spark.createDataFrame([], f"budget_name string, container_id bigint, doc_id {id_type}, piece_no bigint, start_token bigint, n_tokens bigint")
    return out


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, containers, items, fullest, mean_fill, below_half) of packed containers."""
    boxes = packed.groupBy("budget_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return boxes.join(F.broadcast(budgets.distinct()), "budget_name").groupBy("budget_name").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.max("used").alias("fullest"), F.round(F.avg(F.col("used") / F.col("capacity_tokens")), 4).alias("mean_fill"), F.sum((F.col("used") * 2 < F.col("capacity_tokens")).cast("int")).alias("below_half"))


def invariants(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, documents, overfull, misplaced): documents placed; containers above their capacity; documents placed
    twice, divided though they fit, or with a gap between their pieces."""
    known = budgets.select("budget_name", "capacity_tokens").distinct()
    boxes = packed.groupBy("budget_name", "container_id").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(known), "budget_name")
    over = boxes.groupBy("budget_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    astray = F.count_if(F.col("start_token") != F.col("piece_no") * F.col("capacity_tokens"))
    docs = packed.join(F.broadcast(known), "budget_name").groupBy("budget_name", "doc_id", "capacity_tokens").agg(F.count("*").alias("pieces"), F.countDistinct("piece_no").alias("numbers"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("tokens"), astray.alias("astray"))
    bad = (F.col("pieces") != F.col("numbers")) | (F.col("last") != F.col("pieces") - 1) | (F.col("astray") > 0) | ((F.col("tokens") <= F.col("capacity_tokens")) & (F.col("pieces") > 1))
    counted = docs.groupBy("budget_name").agg(F.count("*").alias("documents"), F.count_if(bad).alias("misplaced"))
    return counted.join(over, "budget_name").select("budget_name", "documents", F.col("overfull").cast("int").alias("overfull"), F.col("misplaced").cast("int").alias("misplaced"))

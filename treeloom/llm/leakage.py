"""Benchmark decontamination by winnowing.

Every window of ten benchmark words is known by its smallest five-word hash. Texts are
swept once: of each sliding window only the smallest hash counts, and windows whose hash
a benchmark window has as well go on to a join on the window itself, which is exact.
Joined windows are then extended to whole shared spans. A ten-word window holds six
five-word grams in either text and the choice depends on the window alone, so every shared
span of ten words or more is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm._store import materialise, own_name, sized
from treeloom.llm._words import Block, mixed, words

WINDOW, GRAM = 10, 5
#: The filter that all tasks hold has 2 ** LEAST_BITS bits at least and FREE for each window, 2 ** MOST_BITS (64 MB) at most: a
#: benchmark of many more than 30 million windows fills it, which costs time, never a hit.
LEAST_BITS, MOST_BITS, FREE = 24, 29, 16


def winnowed(block: Block, n: int, gram: int) -> np.ndarray:
    """For each run of n words from word i: its smallest hash over grams of min(gram, n) words. Runs over two texts count too."""
    k = min(gram, n)
    if len(block.hash) < n:
        return np.empty(0, np.uint64)
    grams = np.full(len(block.hash) - k + 1, n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x100000001B3) + block.hash[j : j + len(grams)]
    grams = mixed(grams)
    least = grams[: len(block.hash) - n + 1].copy()
    for j in range(1, n - k + 1):
        np.minimum(least, grams[j : j + len(least)], out=least)
    return least


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """benchmark(item_id, text) as (window text, size, key, items): one row per distinct window; items are strings.

    An item of fewer words than window is one window; an item without words has none.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item": [], "window": [], "size": [], "key": []}
            for block in words(batch.column("text")):
                bounds = np.searchsorted(block.row, np.arange(block.rows + 1))
                least: dict[int, np.ndarray] = {}
                for r in range(block.rows):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    if n not in least:
                        least[n] = winnowed(block, n, gram).view(np.int64)
                    for i in range(a, b - n + 1):
                        out["item"].append(batch.column("item")[block.first + r].as_py())
                        out["window"].append(block.text(i, n))
                        out["size"].append(n)
                        out["key"].append(int(least[n][i]))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("window", pa.string()), ("size", pa.int32()), ("key", pa.int64())]))

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(find, "item string, window string, size int, key long")
    return rows.groupBy("window", "size", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _slots(key: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of winnowed hashes in a filter of 2 ** n_bits bits."""
    shift = np.uint64(64 - n_bits)
    return (key >> shift).astype(np.int64), (key * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)


def _filter(windows: DataFrame) -> tuple[bytes, int, list[int]]:
    """A filter of both places of all keys, its bits, and the window sizes: 2 ** n_bits bits and WINDOW sizes reach the driver."""
    n = windows.count()
    n_bits = min(MOST_BITS, max(LEAST_BITS, (FREE * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots in _slots(batch.column(0).to_numpy().view(np.uint64), n_bits):
                yield pa.RecordBatch.from_arrays([pa.array(slots + 1)], names=["slot"])  # buckets and positions count from 1

    bits = np.zeros(1 << (n_bits - 3), np.uint8)
    rows = windows.select("key").mapInArrow(places, "slot long")
    for r in rows.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toLocalIterator():
        at = (r["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes(), n_bits, sorted(r["size"] for r in windows.select("size").distinct().collect())


def _candidates(spark: SparkSession, bits: bytes, n_bits: int, sizes: list[int], gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    held = spark.sparkContext.broadcast(bits)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("window", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for block in words(batch.column("__text")):
                n_words[block.first : block.first + block.rows] = block.counts()
                begins = np.searchsorted(block.row, np.arange(block.rows))
                for n in sizes:
                    least = winnowed(block, n, gram)
                    first, second = _slots(least, n_bits)
                    some = np.flatnonzero((filled[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
                    some = some[(filled[second[some] >> 3] >> (second[some] & 7).astype(np.uint8)) & 1 > 0]
                    for i in some[block.row[some] == block.row[some + n - 1]].tolist():
                        r = int(block.row[i])
                        found[block.first + r].append({"at": i - int(begins[r]), "size": n, "window": block.text(i, n)})
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n_words), pa.array(found, kind)], names=[*kept.schema.names, "n_words", "__found"])

    return find


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans (at, size)."""
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        none,
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(acc["upto"], x["at"]))).cast("long").alias("total"),
            F.greatest(acc["upto"], x["at"] + x["size"]).alias("upto"),
        ),
        lambda acc: acc["total"],
    )


def merged(spans: Column) -> Column:
    """Sorted spans (at, size) as maximal spans (first, last), last exclusive: hits extended as far as they overlap or touch."""

    def step(acc: Column, x: Column) -> Column:
        a, b = x["at"], x["at"] + x["size"]
        top = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], b).alias("last"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= a), joined).otherwise(F.concat(acc, F.array(F.struct(a.alias("first"), b.alias("last")))))

    return F.aggregate(spans, F.array().cast("array<struct<first:int,last:int>>"), step)


ADDED = ("n_words", "n_hit", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with n_words, n_hit, items (sorted ids as strings) and spans (first,
    last word, last exclusive) of all windows shared with benchmark(item_id, text).

    Null texts, empty texts and texts without words have no words and no hits. An item of fewer words than window is one
    window; without words it is none. An empty benchmark gives no hits; items with equal texts are all found; items with
    a null id count as hits without an id. Repeated rows get the same result each. Input columns named as those added
    are replaced by them.
    """
    spark = docs.sparkSession
    windows, _ = materialise(benchmark_windows(benchmark, window, gram))
    bits, n_bits, sizes = _filter(windows)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    key = F.struct(F.xxhash64(F.lit(1), F.col(text)).alias("a"), F.xxhash64(F.lit(2), F.col(text)).alias("b"))
    rows = docs.select(*keep, key.alias("__key"), F.col(text).alias("__text"))
    made = T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add("n_words", "long").add("__found", T.DataType.fromDDL("array<struct<at:int,size:int,window:string>>"))
    swept, _ = materialise(rows.mapInArrow(_candidates(spark, bits, n_bits, sizes, gram), made))

    some = F.size("__found") > 0
    seen = swept.where(some).select("__key", F.explode("__found").alias("f")).select("__key", "f.*").distinct()
    hits = seen.join(windows.select("window", "items"), "window")
    spans = hits.groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("__spans"))
    items = hits.select("__key", "items").distinct().select("__key", F.explode("items").alias("item")).groupBy("__key").agg(F.sort_array(F.collect_set("item")).alias("__items"))
    found = spans.join(items, "__key", "left")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<first:int,last:int>>")
    kept = [F.col(c) for c in keep]
    with_hits = swept.where(some).drop("__found").join(found, "__key", "left")
    return with_hits.select(
        *kept,
        "n_words",
        F.coalesce(covered(F.col("__spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("__items", no_items).alias("items"),
        F.coalesce(merged(F.col("__spans")), no_spans).alias("spans"),
    ).unionByName(swept.where(~some).select(*kept, "n_words", F.lit(0).cast("long").alias("n_hit"), no_items.alias("items"), no_spans.alias("spans")))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that share a window with the benchmark.

    Null and empty texts and texts without words share none and stay, whatever their ids; rows that repeat go or stay
    together; an empty table or benchmark takes nothing away. What goes is known by two hashes of its text, 16 bytes for
    each different one: broadcast where their measured size allows, so that texts are not shuffled; joined by a shuffle
    of both sides beyond.
    """
    a, b = (own_name(n, docs.columns) for n in ("__a", "__b"))
    key = [F.xxhash64(F.lit(i), F.col(text)) for i in (1, 2)]
    found = decontaminate(docs.select(key[0].alias(a), key[1].alias(b), text), benchmark, text=text, keep=[a, b])
    hit = sized(materialise(found.where("n_hit > 0").select(a, b).distinct())[0], F.lit(48))
    return docs.withColumns({a: key[0], b: key[1]}).join(hit, [a, b], "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

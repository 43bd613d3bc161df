"""Near-duplicate groups by 64-bit similarity fingerprints.

A fingerprint takes the majority of each bit over the XXH64 hashes of a text's three-word
shingles. Fingerprints link at LINK or fewer differing bits. A pair that links agrees in two
of the four 16-bit quarters at least, so all links are among fingerprints that share one of
six half-fingerprints. There the pivot table decides: every fingerprint has its distances to
PIVOTS reference fingerprints, a pair whose distances to any pivot differ by more than LINK
can't link (triangle inequality) and only the rest is verified bit by bit. The join holds
the coordinates in its condition, so it makes verified links only. Halves shared by more
than CROWD different fingerprints go another exact way, without pairs: two fingerprints link
if and only if some 64-bit word is within one bit of both, so each fingerprint is dealt to
its 65 nearest words and the smallest fingerprint at a word stands for those around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm._store import discard, materialise, own_name, sized
from treeloom.llm._words import blocks, mixed

SHINGLE, SEED = 3, 42
LINK = 2
PIVOTS = 16
CROWD = 64

_LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8; 0 without words."""
    found = text.translate(_LOWER).split()  # bytes.split() takes exactly x20 and x09-x0D as white space
    if not found:
        return 0
    n = len(found) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line, of = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    hashes = np.array([of(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) and __fp (long): no shuffle, each text is one row's work."""
    rows = docs.select(*(docs.columns if keep is None else keep), F.col(text).alias("__text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for first, n, data, offsets in blocks(batch.column("__text")):
                for r in range(n):
                    out[first + r] = fingerprint(data[offsets[r] : offsets[r + 1]].tobytes())
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out.view(np.int64))], names=[*kept.schema.names, "__fp"])

    return rows.mapInArrow(find, T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add("__fp", "long"))


def _halves(fp: Column) -> Column:
    """The six choices of two of the four quarters, each as (which, 32 bits)."""
    quarter = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(quarter[a], 16)).bitwiseOR(quarter[b]) for k, (a, b) in enumerate(combinations(range(4), 2))])


def pivot_table(fp: Column) -> Column:
    """Hamming distances to the PIVOTS reference fingerprints, which are fixed pseudo-random words."""
    words = mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(int(w)))).cast("byte") for w in words])


def links(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct: edges (u, v) with the same connected groups as all pairs at LINK or fewer differing bits."""
    dealt = fps.select("fp", F.explode(_halves(F.col("fp"))).alias("half"))
    sizes = dealt.groupBy("half").count().where("count > 1")
    crowded = F.col("count") > CROWD
    shared, _ = materialise(dealt.join(sizes, "half"))
    table = shared.where(~crowded).select("half", "fp", pivot_table(F.col("fp")).alias("pivot"))
    a, b = table.alias("a"), table.alias("b")
    near = F.lit(True)
    for i in range(PIVOTS):
        near &= F.abs(F.col("a.pivot")[i] - F.col("b.pivot")[i]) <= LINK
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= LINK
    pairs = a.join(b, (F.col("a.half") == F.col("b.half")) & (F.col("a.fp") < F.col("b.fp")) & near & verified).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))

    close = shared.where(crowded).select("fp").distinct()
    one_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = close.select("fp", F.explode(F.concat(F.array("fp"), one_bit)).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("word", "v")
    return pairs.unionByName(around.join(least, "word").where("fp <> v").select(F.col("fp").alias("u"), "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node that it reaches.

    Large and small star steps in turn; each step halves paths at least and keeps the number of edges, so the rounds
    grow with the logarithm of the longest path. A node with many edges is met by its minimum, never by its pairs.
    """
    spark = edges.sparkSession
    now, path = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps a link to its minimum, so nothing is cut off
        large = large.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = materialise(small)
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = new, new_path
        if sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sums


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with fingerprint (16 hex digits) and component_id: the smallest id
    that links reach, the row's own included.

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Rows with a null id
    take part; a component of null ids only has a null component_id. Repeated rows share one component. Input columns
    named as those added are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id")]
    own = own_name("__id", [*docs.columns, "__fp"])
    marked, _ = materialise(fingerprints(docs.withColumn(own, F.col(id)), text, [*keep, own]))
    by_fp, _ = materialise(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(own).alias("id"), F.count("*").alias("n")))
    roots, _ = materialise(components(links(by_fp.select("fp"))))
    grouped = by_fp.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    # only fingerprints with another row or another fingerprint beside them need the join back
    linked = grouped.where("n > 1 or node is not null").join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    linked = sized(materialise(linked)[0], F.lit(32))  # a fingerprint may stand for a third of all rows
    return marked.join(linked, "__fp", "left").select(
        *keep, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component_id").isNull(), F.col(own)).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs without the near copies: of each component the row with the smallest id stays (one of them, if it repeats).

    Rows without an id all stay; an empty table stays empty. What goes is a list of ids, broadcast where its measured size
    allows: only rows that repeat the whole id are shuffled with their texts.
    """
    found = near_duplicates(docs.select(text, id), text, id, [id])
    gone, _ = materialise(found.where(F.col("component_id") < F.col(id)).select(id).distinct())
    again, _ = materialise(docs.where(F.col(id).isNotNull()).groupBy(id).count().where("count > 1").select(id))
    width = F.coalesce(F.octet_length(F.col(id).cast("string")), F.lit(0)) + 32
    kept = docs.join(sized(gone, width), id, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = sized(again, width)
    once = kept.join(again, id, "left_semi").dropDuplicates([id])
    return kept.join(again, id, "left_anti").unionByName(once).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])

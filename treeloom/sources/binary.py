"""Binary formats: trees of a section, and matrices of numbers.

Records are made and read as numpy arrays, one for each tree or row; a file is read as a whole, as its
counts stand in front. Little-endian throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.trees import NODE

#: Fields of a node, in the order of the format.
_NODE = np.dtype([("parent", "<i4"), ("branch_length", "<f8"), ("num_events", "<f4"), ("snp_begin", "<i4"), ("snp_end", "<i4")])
#: What a matrix may hold.
KINDS = {"char": "i1", "float": "<f4", "double": "<f8", "int": "<i4"}


def tree_records(trees: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, value): the record of each tree, its first site and its nodes. A tree is a row's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("nodes")
            flat = nodes.flatten()
            whole = np.empty(len(flat), _NODE)
            for name in _NODE.names:
                whole[name] = flat.field(name).to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *pa.compute.list_value_length(nodes).to_pylist()])
            start = np.asarray(batch.column("start_snp").to_numpy(zero_copy_only=False), "<i4")
            out = [start[k].tobytes() + whole[ends[k] : ends[k + 1]].tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "value"])

    types = dict(trees.dtypes)
    return trees.select(*keys, "start_snp", "nodes").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", value binary")


def tree_head(n: int, trees: int, ages: list[float] | None = None) -> bytes:
    """What stands in front of the records: whether there are sample ages, tips, the ages, and the number of trees."""
    return np.array(bool(ages), "?").tobytes() + np.array(n, "<u4").tobytes() + np.array(ages or [], "<f8").tobytes() + np.array(trees, "<u4").tobytes()


def trees(files: DataFrame) -> DataFrame:
    """(path, ages, tree_id, start_snp, nodes) of files(path, content): one row for each tree; ages is null if there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                n = int(np.frombuffer(data, "<u4", 1, 1)[0])
                at = 5
                ages = np.frombuffer(data, "<f8", n, at).tolist() if data[0] else None
                at += 8 * n * bool(data[0])
                count = int(np.frombuffer(data, "<u4", 1, at)[0])
                record = np.dtype([("start_snp", "<i4"), ("nodes", _NODE, (2 * n - 1,))])
                for k, r in enumerate(np.frombuffer(data, record, count, at + 4)):
                    yield pd.DataFrame({"path": [path], "ages": [ages], "tree_id": [k], "start_snp": [int(r["start_snp"])], "nodes": [[dict(zip(_NODE.names, x.item(), strict=True)) for x in r["nodes"]]]})

    return files.select("path", "content").mapInPandas(run, f"path string, ages array<double>, tree_id int, start_snp int, nodes array<{NODE}>")


def matrix_rows(rows: DataFrame, kind: str, key: str = "row", values: str = "values") -> DataFrame:
    """(key, value): the bytes of each row of a matrix; matrix_head and the rows in order are the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "value": [np.asarray(x, KINDS[kind]).tobytes() for x in batch[values]]})

    return rows.select(key, F.col(values).cast("array<double>").alias(values)).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, value binary")


def matrix_head(rows: int, columns: int) -> bytes:
    return np.array([rows, columns], "<u8").tobytes()


def matrices(files: DataFrame, kind: str) -> DataFrame:
    """(path, row, values) of files(path, content) of one matrix each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                n, m = (int(x) for x in np.frombuffer(data, "<u8", 2))
                whole = np.frombuffer(data, KINDS[kind], n * m, 16).reshape(n, m).astype(float)
                for a in range(0, n, 1024):
                    yield pd.DataFrame({"path": path, "row": np.arange(a, min(n, a + 1024)), "values": list(whole[a : a + 1024])})

    return files.select("path", "content").mapInPandas(run, "path string, row long, values array<double>")


def haplotypes(sites: DataFrame) -> DataFrame:
    """sites(snp_id, gt) as rows of a matrix of signs."""
    return matrix_rows(sites.select("snp_id", F.transform(F.split("gt", ""), lambda c: F.ascii(c)).alias("values")), "char", "snp_id")

"""Text formats as typed DataFrames.

Each parser takes lines(value), so that any Spark source of lines will do; read(spark, path)
gives the lines of plain or compressed files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import alleles
from treeloom.store import materialise


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file that may be gzip whatever its name: told by its first bytes. One file is one row's work."""
    import gzip

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                text = gzip.decompress(data) if data[:3] == b"\x1f\x8b\x08" else data
                lines = text.decode().split("\n")
                yield pd.DataFrame({"value": lines[:-1] if lines and not lines[-1] else lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line, from 0, in the order of the file: partitions are counted first, then numbered by running sums.

    Lines are written with their places first: lines that come from a shuffle, made once for the counts and once more for
    the rows, may lie in other partitions the second time.
    """
    kept = materialise(lines.select("value", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")))[0]
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    w = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))  # a row for each partition
    return kept.join(F.broadcast(starts), "__part").select((F.col("__start") + F.col("__id") - F.col("__first")).alias("line"), "value")


def _fields(sep: str = " +") -> Column:
    return F.split(F.trim(F.col("value")), sep)


def _after_header(lines: DataFrame, header: int) -> DataFrame:
    return numbered(lines).where(F.col("line") >= header)


def haps(lines: DataFrame) -> DataFrame:
    """chrom, rsid, pos, anc, alt, gt of haplotype lines; only 0 and 1 count as alleles."""
    f = _fields()
    gt = F.regexp_replace(F.array_join(F.slice(f, F.lit(6), F.greatest(F.size(f) - 5, F.lit(0))), ""), "[^01]", "")
    return lines.where(F.length(F.trim("value")) > 0).select(f[0].alias("chrom"), f[1].alias("rsid"), f[2].cast("long").alias("pos"), f[3].alias("anc"), f[4].alias("alt"), gt.alias("gt"))


def samples(lines: DataFrame) -> DataFrame:
    """id, ploidy: 2 where both ids agree, else 1; two header lines are skipped."""
    f = _fields()
    return _after_header(lines, 2).where(F.length(F.trim("value")) > 0).select("line", f[0].alias("id"), F.when(f[0] == f[1], 2).otherwise(1).alias("ploidy"))


def genetic_map(lines: DataFrame) -> DataFrame:
    f = _fields()
    return _after_header(lines, 1).select(f[0].cast("long").alias("bp"), f[1].cast("double").alias("rate"), f[2].cast("double").alias("cm"))


def fasta(lines: DataFrame) -> DataFrame:
    """One row with the upper-case sequence; the first line is skipped."""
    rows = _after_header(lines, 1).groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: F.trim(x["value"])), "").alias("sequence"))
    return rows.select(F.upper("sequence").alias("sequence"))


def poplabels(lines: DataFrame) -> DataFrame:
    """sample, population, region, ploidy; a fourth field of 1 is one haplotype, else two. Mixed ploidy is an error."""
    f = _fields()
    rows = _after_header(lines, 1).where(F.length(F.trim("value")) > 0).select("line", f[0].alias("sample"), f[1].alias("population"), F.get(f, F.lit(2)).alias("region"), F.when(F.get(f, F.lit(3)) == "1", 1).otherwise(2).alias("ploidy"))
    kinds = F.size(F.collect_set("ploidy").over(Window.partitionBy(F.lit(0))))
    checked = rows.withColumn("ploidy", F.when(kinds > 1, F.raise_error(F.lit("samples of one and of two haplotypes")).cast("int")).otherwise(F.col("ploidy")))
    return checked


def haplotype_groups(labels: DataFrame) -> DataFrame:
    """(hap, grp, region): one row for each haplotype, in the order of the samples."""
    each = labels.select("line", F.explode(F.sequence(F.lit(1), F.col("ploidy"))).alias("k"), F.col("population").alias("grp"), "region")
    return each.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line", "k")) - 1).alias("hap"), "grp", "region")


def tree_nodes(value: Column) -> Column:
    """Nodes of one tree line: tokens parent:(length events first last)."""
    tokens = F.regexp_extract_all(value, F.lit(r"(-?\d+:\([^)]*\))"), F.lit(1))

    def node(t: Column) -> Column:
        f = F.split(F.regexp_replace(t, r"^(-?\d+):\(\s*|\)$", "$1 "), r"\s+")
        return F.struct(f[0].cast("int").alias("parent"), f[1].cast("double").alias("branch_length"), f[2].cast("float").alias("num_events"), f[3].cast("int").alias("snp_begin"), f[4].cast("int").alias("snp_end"))

    return F.transform(tokens, node)


def anc(lines: DataFrame) -> DataFrame:
    """tree_id, start_snp, nodes; two header lines."""
    rows = _after_header(lines, 2).where(F.col("value").contains(":("))
    return rows.select((F.col("line") - 2).cast("int").alias("tree_id"), F.regexp_extract("value", r"^\s*(\d+):\s", 1).cast("int").alias("start_snp"), tree_nodes(F.regexp_replace("value", r"^\s*\d+:\s", "")).alias("nodes"))


def anc_ages(lines: DataFrame) -> DataFrame:
    """(hap, age) from the first header line, if it has ages."""
    first = numbered(lines).where("line = 0")
    f = F.split(F.trim("value"), " +")
    return first.select(F.posexplode(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0)))).alias("hap", "age")).select("hap", F.col("age").cast("double").alias("age"))


def mut(lines: DataFrame) -> DataFrame:
    """Eleven fields by semicolon; flanks and counts of populations, named by the header, as a map, if they are there."""
    all_ = numbered(lines)
    header = F.broadcast(all_.where("line = 0").select(F.split(F.trim("value"), ";").alias("__head")))
    f = F.split("value", ";")
    rows = all_.where((F.col("line") > 0) & (F.length(F.trim("value")) > 0)).join(header)
    name = lambda i: F.get(f, F.lit(i))
    counts = F.transform(F.filter(F.slice(f, F.lit(14), F.greatest(F.size(f) - 13, F.lit(0))), lambda x: F.length(x) > 0), lambda x: x.cast("int"))
    names = F.slice(F.col("__head"), F.lit(14), F.size(counts))
    return rows.select(
        name(0).cast("int").alias("snp"),
        name(1).cast("long").alias("pos"),
        name(2).cast("long").alias("dist"),
        name(3).alias("rsid"),
        name(4).cast("int").alias("tree_id"),
        F.transform(F.filter(F.split(F.trim(name(5)), " +"), lambda x: F.length(x) > 0), lambda x: x.cast("int")).alias("branches"),
        (name(6) == "1").alias("unmapped"),
        (name(7) == "1").alias("flipped"),
        name(8).cast("double").alias("age_begin"),
        name(9).cast("double").alias("age_end"),
        name(10).alias("mutation_type"),
        F.nullif(name(11), F.lit("NA")).alias("upstream"),
        F.nullif(name(12), F.lit("NA")).alias("downstream"),
        F.map_from_arrays(names, counts).alias("freq"),
    )


def mut_short(lines: DataFrame) -> DataFrame:
    """tree_id, branches, unmapped, flipped, ages of the short format; sites have the numbers of their lines, from 0."""
    f = F.split("value", ";")
    rows = _after_header(lines, 1).where(F.length(F.trim("value")) > 0)
    return rows.select(
        (F.col("line") - 1).cast("int").alias("snp"),
        f[0].cast("int").alias("tree_id"),
        F.transform(F.filter(F.split(F.trim(f[1]), " +"), lambda x: F.length(x) > 0), lambda x: x.cast("int")).alias("branches"),
        (f[2] == "1").alias("unmapped"),
        (f[3] == "1").alias("flipped"),
        f[4].cast("double").alias("age_begin"),
        f[5].cast("double").alias("age_end"),
    )


def dist(lines: DataFrame) -> DataFrame:
    f = _fields()
    return lines.where(~F.startswith(F.trim(F.col("value")), F.lit("#"))).select(f[0].cast("long").alias("pos"), f[1].cast("long").alias("dist"))


def hap_legend(hap: DataFrame, legend: DataFrame, chrom: str) -> DataFrame:
    """Haplotype matrix and legend zipped by line; legends of five fields keep biallelic SNPs only."""
    a = numbered(hap).select("line", F.regexp_replace("value", "[^01]", "").alias("gt"))
    f = _fields()
    b = numbered(legend).where("line > 0").select((F.col("line") - 1).alias("line"), f[0].alias("rsid"), f[1].cast("long").alias("pos"), f[2].alias("anc"), f[3].alias("alt"), F.get(f, F.lit(4)).alias("type"))
    from treeloom.operators.cleaning import biallelic

    return biallelic(b.join(a, "line")).select(F.lit(chrom).alias("chrom"), "rsid", "pos", "anc", "alt", "gt")


def coal(lines: DataFrame) -> DataFrame:
    """(group1, group2, epoch, lo, rate): a line of groups, one of epochs, and one for each pair."""
    all_ = numbered(lines).where(F.length(F.trim("value")) > 0)
    groups = all_.where("line = 0").select(F.split(F.trim("value"), " +").alias("__groups"))
    bounds = all_.where("line = 1").select(F.split(F.trim("value"), " +").alias("__bounds"))
    f = _fields()
    rows = all_.where("line > 1").select(f[0].cast("int").alias("a"), f[1].cast("int").alias("b"), F.posexplode(F.slice(f, F.lit(3), F.size(f))).alias("epoch", "rate"))
    out = rows.join(F.broadcast(groups)).join(F.broadcast(bounds))  # one row each
    return out.select(F.get("__groups", "a").alias("group1"), F.get("__groups", "b").alias("group2"), "epoch", F.get("__bounds", "epoch").cast("double").alias("lo"), F.when(~F.lower("rate").isin("nan", "-nan"), F.col("rate").cast("double")).alias("rate"))


def group_names_match(rates: DataFrame, labels: DataFrame) -> DataFrame:
    """rates, or an error for a group that the labels don't have."""
    known = labels.select(F.col("population").alias("group1")).distinct().withColumn("__known", F.lit(True))
    checked = rates.join(F.broadcast(known), "group1", "left")
    error = F.raise_error(F.concat(F.lit("unknown group "), F.col("group1"))).cast("string")
    return checked.withColumn("group1", F.when(F.col("__known"), F.col("group1")).otherwise(error)).drop("__known")


def mutation_rates(lines: DataFrame) -> DataFrame:
    f = _fields()
    return numbered(lines).where(F.length(F.trim("value")) > 0).select(F.col("line").cast("int").alias("epoch"), f[0].cast("double").alias("lo"), f[1].cast("double").alias("rate"))


def sample_ages(lines: DataFrame, n: int) -> list[float]:
    """Ages of n haplotypes; zeros if the file has fewer."""
    got = [float(r["value"]) for r in numbered(lines).where(F.length(F.trim("value")) > 0).orderBy("line").limit(n).collect()]
    return got if len(got) == n else [0.0] * n


def categories(lines: DataFrame) -> DataFrame:
    f = _fields()
    return _after_header(lines, 1).select(f[0].alias("up"), f[1].alias("down"), f[2].alias("anc"), f[3].alias("der"), f[4].cast("int").alias("category"))


def chromosomes(lines: DataFrame) -> list[str]:
    """A short list, one name a line."""
    return [r["value"].strip() for r in numbered(lines).orderBy("line").collect() if r["value"].strip()]


def site_strings(lines: DataFrame) -> DataFrame:
    """pos and gt of tab-separated lines; lines of other kinds, which begin with a letter, are skipped."""
    f = F.split("value", "\t")
    return lines.where(F.col("value").rlike(r"^\d")).select(f[0].cast("long").alias("pos"), f[1].alias("gt"))


def frequencies(lines: DataFrame) -> DataFrame:
    """(pos, rsid, epoch, value) of a table with a header of epochs."""
    all_ = numbered(lines)
    head = F.broadcast(all_.where("line = 0").select(F.split(F.trim("value"), " +").alias("__head")))
    f = _fields()
    rows = all_.where("line > 0").select(f[0].cast("long").alias("pos"), f[1].alias("rsid"), F.posexplode(F.slice(f, F.lit(3), F.size(f))).alias("k", "x")).join(head)
    return rows.select("pos", "rsid", F.col("k").alias("epoch"), F.get("__head", F.col("k") + 2).alias("name"), F.col("x").cast("double").alias("value"))


def simulated(lines: DataFrame, length: int) -> DataFrame:
    """(run, pos, gt) of coalescent-simulator output: runs after //, positions as shares of the length; doubled ones go."""

    def one(text: str) -> list[tuple[int, int, str]]:
        out = []
        for k, part in enumerate(text.split("//")[1:]):
            rows = part.strip().split("\n")
            at = next((i for i, x in enumerate(rows) if x.startswith("positions:")), None)
            if at is None:
                continue
            pos = [math.ceil(float(x) * length) for x in rows[at].split()[1:]]
            seqs = [x.strip() for x in rows[at + 1 :] if x.strip()]
            out += [(k, p, "".join(s[i] for s in seqs)) for i, p in enumerate(pos) if pos.count(p) == 1]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame(one(text), columns=["run", "pos", "gt"])

    whole = numbered(lines).groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return whole.mapInPandas(run, "run int, pos long, gt string")


def parse_newick(text: str) -> tuple[list[int], list[float], list[str]]:
    """(parent, length, name) of every node; tips are numbered by name if names are numbers, else as they come."""
    nodes: list[list] = []  # parent, length, name, is_tip
    stack: list[int] = []
    i, last = 0, -1
    text = text.strip().rstrip(";")
    while i < len(text):
        c = text[i]
        if c == "(":
            nodes.append([stack[-1] if stack else -1, 0.0, "", False])
            stack.append(len(nodes) - 1)
            i += 1
        elif c in ",":
            i += 1
        elif c == ")":
            last = stack.pop()
            i += 1
        elif c == "[":
            i = text.index("]", i) + 1
        elif c == ":":
            j = i + 1
            while j < len(text) and text[j] not in ",()[;":
                j += 1
            nodes[last][1] = float(text[i + 1 : j])
            i = j
        else:
            j = i
            while j < len(text) and text[j] not in ",():[;":
                j += 1
            if i and text[i - 1] == ")":
                nodes[last][2] = text[i:j]
            elif text[i:j].strip():
                nodes.append([stack[-1] if stack else -1, 0.0, text[i:j].strip(), True])
                last = len(nodes) - 1
            i = j
    tips = [k for k, x in enumerate(nodes) if x[3]]
    if all(nodes[k][2].isdigit() for k in tips):
        tips.sort(key=lambda k: int(nodes[k][2]))
    inner = [k for k in range(len(nodes) - 1, -1, -1) if not nodes[k][3]]
    label = {k: i for i, k in enumerate([*tips, *inner])}
    order = sorted(label, key=label.get)
    return [label.get(nodes[k][0], -1) for k in order], [nodes[k][1] for k in order], [nodes[k][2] for k in order]


def newick_trees(rows: DataFrame, newick: str = "tree", scale: float = 1.0) -> DataFrame:
    """rows with nodes parsed from a newick column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[newick]:
                p, le, _ = parse_newick(text)
                out.append([{"parent": a, "branch_length": b * scale, "num_events": 0.0, "snp_begin": 0, "snp_end": 0} for a, b in zip(p, le, strict=True)])
            yield batch.drop(columns=[newick]).assign(nodes=out)

    from treeloom.operators.trees import NODE

    head = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k != newick)
    return rows.mapInPandas(run, f"{head}{', ' if head else ''}nodes array<{NODE}>")


def newick_intervals(lines: DataFrame) -> DataFrame:
    """chrom, start, end, sample, nodes of tab-separated lines with a header."""
    f = F.split("value", "\t")
    rows = _after_header(lines, 1).where(F.length("value") > 0).select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].cast("int").alias("sample"), f[4].alias("tree"))
    return newick_trees(rows)


def smc_trees(lines: DataFrame) -> DataFrame:
    """start, end, nodes of sequentially-Markov output: TREE lines hold an interval and a newick tree."""
    f = F.split("value", "\t")
    rows = lines.where(F.startswith(F.col("value"), F.lit("TREE\t"))).select(f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].alias("tree"))
    return newick_trees(rows)


def position_trees(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """pos and nodes of lines with a position, then a newick tree."""
    f = F.split(F.trim("value"), r"[\s]+", 2)
    return newick_trees(lines.where(F.col("value").contains("(")).select(f[0].cast("double").alias("pos"), f[1].alias("tree")), scale=scale)


def coalescence_lists(lines: DataFrame) -> DataFrame:
    """start, end, nodes of [length](newick) lines, as simulators print them; ranges are running sums."""
    rows = numbered(lines).select("line", F.regexp_extract("value", r"^\[(\d+)\]", 1).cast("long").alias("length"), F.regexp_replace("value", r"^\[\d+\]", "").alias("tree")).where("length is not null")
    w = Window.partitionBy(F.lit(0)).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return newick_trees(rows.withColumn("end", F.sum("length").over(w)).withColumn("start", F.col("end") - F.col("length")).drop("line", "length"))


def timeb(spark: SparkSession, path: str) -> DataFrame:
    """pos, anc, der, daf, n, sample, ancestral_times, derived_times of binary files, one row for each site and sample."""
    import struct

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                n_snps, n_samples = struct.unpack_from("<ii", data)
                at, out = 8, []
                for _ in range(n_snps):
                    pos, a, d, daf, n = struct.unpack_from("<iccii", data, at)
                    at += struct.calcsize("<iccii")
                    k_anc, k_der = n - daf, max(daf - 1, 0)
                    anc_ = struct.unpack_from(f"<{n_samples * k_anc}f", data, at)
                    at += 4 * n_samples * k_anc
                    der = struct.unpack_from(f"<{n_samples * k_der}f", data, at)
                    at += 4 * n_samples * k_der
                    out += [(pos, a.decode(), d.decode(), daf, n, s, list(anc_[s * k_anc : (s + 1) * k_anc]), list(der[s * k_der : (s + 1) * k_der])) for s in range(n_samples)]
                yield pd.DataFrame(out, columns=["pos", "anc", "der", "daf", "n", "sample", "ancestral_times", "derived_times"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "pos int, anc string, der string, daf int, n int, sample int, ancestral_times array<float>, derived_times array<float>")


def vcf(lines: DataFrame, polymorphic: bool = True) -> DataFrame:
    from treeloom.operators.cleaning import genotypes

    return genotypes(lines, polymorphic=polymorphic)


def masked(sequence: Column, pos: Column) -> Column:
    """Whether a base of a mask passes."""
    return alleles.base_at(sequence, pos) == "P"

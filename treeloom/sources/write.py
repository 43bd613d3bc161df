"""DataFrames as lines of the text formats; write() stores them, one file for each table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write(lines: DataFrame, path: str, order: list[str], header: list[str] | None = None, gzip: bool = False) -> None:
    """Lines in order, after a header. Small tables and single chromosomes go to one file, as the formats ask for."""
    rows = lines.select(F.lit(1).alias("__part"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], "value")
    if header:
        top = lines.sparkSession.createDataFrame([(0, i, h) for i, h in enumerate(header)], "__part int, __o0 long, value string")
        rows = rows.withColumn("__o0", F.col("__o0").cast("long")).unionByName(top, allowMissingColumns=True)
    w = rows.repartitionByRange(1, "__part").sortWithinPartitions("__part", *[f"__o{i}" for i in range(len(order))]).select("value").write
    w.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def haps_lines(sites: DataFrame) -> DataFrame:
    return sites.select("pos", F.concat_ws(" ", "chrom", "rsid", F.col("pos").cast("string"), "anc", "alt", F.array_join(F.split("gt", ""), " ")).alias("value"))


def sample_lines(samples: DataFrame) -> DataFrame:
    return samples.select("line", F.concat_ws(" ", "id", F.when(F.col("ploidy") == 2, F.col("id")).otherwise("NA"), F.lit("0")).alias("value"))


SAMPLE_HEADER = ["ID_1 ID_2 missing", "0 0 0"]


def anc_lines(trees: DataFrame) -> DataFrame:
    """start: parent:(length events first last) ... with five and three decimals."""
    node = lambda x: F.format_string("%d:(%.5f %.3f %d %d)", x["parent"], x["branch_length"], x["num_events"].cast("double"), x["snp_begin"], x["snp_end"])
    return trees.select("tree_id", F.concat(F.col("start_snp").cast("string"), F.lit(": "), F.array_join(F.transform("nodes", node), " "), F.lit(" ")).alias("value"))


def anc_header(n: int, trees: int, ages: list[float] | None = None) -> list[str]:
    return ["NUM_HAPLOTYPES " + " ".join([str(n), *(f"{a:g}" for a in ages or [])]), f"NUM_TREES {trees}"]


def sampled_anc_lines(trees: DataFrame) -> DataFrame:
    """As anc_lines, each node with the lengths of all samples in front of its events. samples: [sample][node]."""

    def node(x: Column, i: Column) -> Column:
        lengths = F.array_join(F.transform("samples", lambda s: F.format_string("%.5f", F.get(s, i))), " ")
        return F.concat(x["parent"].cast("string"), F.lit(":("), lengths, F.format_string(" %.3f %d %d)", x["num_events"].cast("double"), x["snp_begin"], x["snp_end"]))

    return trees.select("tree_id", F.concat(F.col("start_snp").cast("string"), F.lit(": "), F.array_join(F.transform("nodes", node), " "), F.lit(" ")).alias("value"))


MUT_HEADER = "snp;pos_of_snp;dist;rs-id;tree_index;branch_indices;is_not_mapping;is_flipped;age_begin;age_end;ancestral_allele/alternative_allele;"


def _number(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")), "nan").otherwise(F.format_string("%s", c.cast("double").cast("string")))


def mut_lines(muts: DataFrame, populations: list[str] | None = None) -> DataFrame:
    """Eleven fields; with populations also flanks and the count of each from the map freq."""
    fields = [F.col("snp").cast("string"), F.col("pos").cast("string"), F.col("dist").cast("string"), F.col("rsid"), F.col("tree_id").cast("string"), F.array_join("branches", " "), (F.size("branches") != 1).cast("int").cast("string"), F.col("flipped").cast("int").cast("string"), _number(F.col("age_begin")), _number(F.col("age_end")), F.col("mutation_type")]
    if populations:
        fields += [F.coalesce("upstream", F.lit("NA")), F.coalesce("downstream", F.lit("NA")), *[F.coalesce(F.col("freq")[p].cast("string"), F.lit("0")) for p in populations]]
    return muts.select("snp", F.concat(F.concat_ws(";", *fields), F.lit(";")).alias("value"))


def mut_header(populations: list[str] | None = None) -> list[str]:
    return [MUT_HEADER + ("upstream_allele;downstream_allele;" + "".join(f"{p};" for p in populations) if populations else "")]


#: Fixed value: the header of the short format, whose last name stands for two columns.
MUT_SHORT_HEADER = "tree_index;branch_index;is_mapping;is_flipped;age_of_mutation"


def mut_short_lines(muts: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Six fields of each mutation, of the sites first to last of a section if given; ages with six digits."""
    rows = muts if first is None else muts.where(F.col("snp").between(first, last))
    age = lambda c: F.format_string("%s", F.round(F.col(c).cast("double"), 6))
    fields = [F.col("tree_id").cast("string"), F.array_join("branches", " "), (F.size("branches") > 1).cast("int").cast("string"), F.col("flipped").cast("int").cast("string"), age("age_begin"), age("age_end")]
    return rows.select("snp", F.concat(F.concat_ws(";", *fields), F.lit(";")).alias("value"))


def coal_lines(rates: DataFrame, groups: list[str], bounds: list[float]) -> tuple[DataFrame, list[str]]:
    """One line for each pair of groups, by number; null rates are nan."""
    number = {g: i for i, g in enumerate(groups)}
    of = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    wide = rates.groupBy("group1", "group2").agg(F.sort_array(F.collect_list(F.struct("epoch", "rate"))).alias("x"))
    value = F.concat_ws(" ", of[F.col("group1")].cast("string"), of[F.col("group2")].cast("string"), F.array_join(F.transform("x", lambda r: _number(r["rate"])), " "))
    return wide.select((of[F.col("group1")] * len(groups) + of[F.col("group2")]).alias("line"), value.alias("value")), [" ".join(groups), " ".join(f"{b:g}" for b in bounds)]


def matrix_lines(rows: DataFrame, key: list[str], columns: list[str], missing: str = "nan") -> tuple[DataFrame, list[str]]:
    """Any pivoted table with spaces between its columns."""
    value = F.concat_ws(" ", *[F.col(k).cast("string") for k in key], *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns])
    return rows.select(*key, value.alias("value")), [" ".join([*key, *columns])]


def newick_lines(trees: DataFrame) -> tuple[DataFrame, list[str]]:
    return trees.select("start", F.concat_ws("\t", F.col("chrom").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("sample").cast("string"), "newick").alias("value")), ["chrom\tstart\tend\tMCMC_sample\ttree"]


def dist_lines(muts: DataFrame) -> tuple[DataFrame, list[str]]:
    return muts.select("pos", F.concat_ws(" ", F.col("pos").cast("string"), F.col("dist").cast("string")).alias("value")), ["#pos dist"]


def annot_lines(sites: DataFrame, populations: list[str]) -> tuple[DataFrame, list[str]]:
    fields = [F.coalesce("upstream", F.lit("NA")), F.coalesce("downstream", F.lit("NA")), *[F.coalesce(F.col("freq")[p].cast("string"), F.lit("0")) for p in populations]]
    return sites.select("pos", F.concat(F.concat_ws(";", *fields), F.lit(";")).alias("value")), ["upstream_allele;downstream_allele;" + "".join(f"{p};" for p in populations)]


def timeb(rows: DataFrame, n_samples: int) -> DataFrame:
    """(pos, data): the record of each site; the file is n_sites, n_samples as int32, then the records by position.

    rows(pos, anc, der, daf, n, ancestral_times, derived_times): times of all samples, one after the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                data = struct.pack("<iccii", int(r.pos), r.anc.encode(), r.der.encode(), int(r.daf), int(r.n))
                out.append(data + struct.pack(f"<{len(r.ancestral_times)}f", *r.ancestral_times) + struct.pack(f"<{len(r.derived_times)}f", *r.derived_times))
            yield pd.DataFrame({"pos": batch["pos"], "data": out})

    return rows.select("pos", "anc", "der", "daf", "n", "ancestral_times", "derived_times").mapInPandas(run, f"pos {dict(rows.dtypes)['pos']}, data binary")

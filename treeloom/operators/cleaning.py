"""Cleaning and annotating haplotype tables.

sites(chrom, snp_id, pos, rsid, anc, alt, gt): gt is a string of 0 and 1, one sign for each
haplotype; groups(hap, grp) names the group of each haplotype.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import alleles
from treeloom.operators.intervals import WIDTH


def unique_positions(sites: DataFrame, by: list[str] = ["chrom"], pos: str = "pos") -> DataFrame:  # noqa: B006
    """Sites whose position no other site has; all of a group of equals go."""
    same = F.count("*").over(Window.partitionBy(*by, pos))
    return sites.withColumn("__same", same).where("__same = 1").drop("__same")


def biallelic(legend: DataFrame, kind: str = "type") -> DataFrame:
    """Rows without a type, or of the biallelic type."""
    return legend.where(F.col(kind).isNull() | (F.col(kind) == "Biallelic_SNP"))


def single_bases(sites: DataFrame, ref: str = "anc", alt: str = "alt") -> DataFrame:
    return sites.where((F.length(ref) == 1) & (F.length(alt) == 1))


def segregating(sites: DataFrame) -> DataFrame:
    """Sites at which some but not all haplotypes are derived."""
    n = alleles.carriers(F.col("gt"))
    return sites.where((n > 0) & (n < F.length("gt")))


def pass_mask(bases: DataFrame, by: list[str] = ["chrom"], p: str = "p", ok: str = "ok", reach: int = 1000, most: int = 2000, width: int = WIDTH) -> DataFrame:  # noqa: B006
    """Bases of a mask that pass and have fewer than `most` failing ones from reach before to reach after.

    Stretches of width bases are one task's rows each, with the bases within reach of their ends from the stretches beside
    them; the failing bases before a stretch are a running sum of the stretches' totals.
    """
    width = max(width, reach + 1)
    own = F.floor(F.col(p) / width).cast("long")
    failing = F.sum((~F.col(ok)).cast("long"))
    near = F.array_distinct(F.array(own, F.floor((F.col(p) - reach) / width).cast("long"), F.floor((F.col(p) + reach) / width).cast("long")))
    rows = bases.withColumn("__own", own).withColumn("__stretch", F.explode(near))
    w = Window.partitionBy(*by, "__stretch").orderBy(p)
    before = failing.over(w.rangeBetween(Window.unboundedPreceding, -1))
    # of the bases before a stretch that are with it, the ones that its running sum has counted
    beside = F.sum(((F.col("__own") < F.col("__stretch")) & ~F.col(ok)).cast("long")).over(Window.partitionBy(*by, "__stretch"))
    rows = rows.withColumns({"failing_near": failing.over(w.rangeBetween(-reach, reach)), "__run": F.coalesce(before, F.lit(0)) - beside}).where("__own = __stretch")
    along = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = bases.withColumn("__stretch", own).groupBy(*by, "__stretch").agg(failing.alias("__total")).select(*by, "__stretch", F.coalesce(F.sum("__total").over(along), F.lit(0)).alias("__earlier"))
    out = rows.join(totals, [*by, "__stretch"]).withColumn("failing_before", F.col("__run") + F.col("__earlier"))
    return out.where(F.col(ok) & (F.col("failing_near") < most)).select(*bases.columns, "failing_near", "failing_before")


def filter_by_mask(sites: DataFrame, bases: DataFrame, by: list[str] = ["chrom"], reach: int = 1000, most: int = 2000) -> DataFrame:  # noqa: B006
    """Sites on good bases of a mask, with dist: passing bases to the next such site, 1 at least and for the last."""
    kept = sites.join(pass_mask(bases, by, reach=reach, most=most).withColumnRenamed("p", "pos"), [*by, "pos"])
    w = Window.partitionBy(*by).orderBy("pos")
    passing = (F.lead("pos").over(w) - F.col("pos")) - (F.lead("failing_before").over(w) - F.col("failing_before"))
    return kept.withColumn("dist", F.greatest(F.coalesce(passing, F.lit(1)), F.lit(1))).drop("ok", "failing_near", "failing_before")


def polarise(sites: DataFrame, ancestor: Column) -> DataFrame:
    """Sites whose ancestral base is one of their alleles; where it is the second, alleles and haplotypes are swapped."""
    a = F.upper(ancestor)
    same, swap = a == F.upper("anc"), a == F.upper("alt")
    return sites.where((F.length("anc") == 1) | (F.length("alt") == 1)).where(same | swap).withColumns(
        {"anc": F.when(same, F.col("anc")).otherwise(F.col("alt")), "alt": F.when(same, F.col("alt")).otherwise(F.col("anc")), "gt": F.when(same, F.col("gt")).otherwise(alleles.flip(F.col("gt")))}
    )


def transversions(sites: DataFrame) -> DataFrame:
    """sites with state: 1 for changes that count for branch lengths, 0 for transitions."""
    return sites.withColumn("state", alleles.transversion(F.col("anc"), F.col("alt")).cast("int"))


def remove_haplotypes(sites: DataFrame, keep: list[int], drop_fixed: bool = True) -> DataFrame:
    """sites for the haplotypes keep; fixed sites go unless they are asked for."""
    out = sites.withColumn("gt", alleles.pick(F.col("gt"), keep))
    return segregating(out) if drop_fixed else out


def remove_samples(haps: DataFrame, removed: DataFrame, hap: str = "hap") -> DataFrame:
    """Long haplotype rows without those of the listed haplotypes."""
    return haps.join(removed, hap, "left_anti")


def samples_of_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    return groups.join(wanted, "grp", "left_semi")


def groups_of_interest(groups: DataFrame, names: str) -> DataFrame:
    """The distinct groups of a comma-separated list, or all; an unknown name is an error."""
    known = groups.select("grp").distinct()
    if names == "All":
        return known
    listed = groups.sparkSession.createDataFrame([(x.strip(),) for x in dict.fromkeys(names.split(","))], "grp string")
    checked = listed.join(known.withColumn("__known", F.lit(True)), "grp", "left")
    error = F.raise_error(F.concat(F.lit("unknown group "), F.col("grp"))).cast("string")
    return checked.select(F.when(F.col("__known"), F.col("grp")).otherwise(error).alias("grp"))


def allele_counts(haps: DataFrame) -> DataFrame:
    """(snp_id, carriers, n) of long haplotype rows."""
    return haps.groupBy("snp_id").agg(F.sum("allele").alias("carriers"), F.count("*").alias("n"))


def group_counts(haps: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(snp_id, grp, carriers, n): carriers of each group; groups is joined if the rows don't name theirs."""
    rows = haps if groups is None else haps.join(groups, "hap")
    return rows.groupBy("snp_id", "grp").agg(F.sum("allele").alias("carriers"), F.count("*").alias("n"))


def annotate(sites: DataFrame, ancestor: str, counts: DataFrame) -> DataFrame:
    """sites with upstream and downstream bases of a sequence column and one carrier count for each group."""
    seq, pos = F.col(ancestor), F.col("pos")
    wide = counts.groupBy("snp_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("grp", "carriers")))).alias("freq"))
    flanks = sites.withColumns({"upstream": alleles.base_at(seq, pos - 1), "downstream": alleles.base_at(seq, pos + 1)})
    return flanks.join(wide, "snp_id", "left")


def new_positions(sites: DataFrame, known: DataFrame, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Sites at positions that known doesn't have."""
    return sites.join(known.select(*by, "pos").distinct(), [*by, "pos"], "left_anti")


def merged_sites(old: DataFrame, new: DataFrame, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Old sites and those new ones that are at other positions, numbered by position."""
    both = old.unionByName(new_positions(new, old, by), allowMissingColumns=True)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "snp_id")))


def genotypes(lines: DataFrame, value: str = "value", polymorphic: bool = True) -> DataFrame:
    """Sites of VCF lines: single-base alleles, phased or unphased, one or two alleles a sample; ids have no semicolon.

    Counts alleles as they are; monomorphic sites go if polymorphic.
    """
    f = F.split(value, "\t")
    calls = F.transform(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))), lambda x: F.translate(F.element_at(F.split(x, ":"), 1), "|/", ""))
    rows = lines.where(~F.startswith(F.col(value), F.lit("#"))).select(
        f[0].alias("chrom"), f[1].cast("long").alias("pos"), alleles.safe_name(f[2]).alias("rsid"), f[3].alias("anc"), f[4].alias("alt"), F.array_join(calls, "").alias("gt")
    )
    rows = single_bases(rows).where(F.col("gt").rlike("^[01]+$"))
    return segregating(rows) if polymorphic else rows


def group_names(groups: DataFrame) -> DataFrame:
    """(grp, number): the distinct names in order, numbered from 0. Groups are a short list."""
    names = groups.select("grp").where("grp is not null").distinct()
    return names.withColumn("number", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("grp")) - 1).cast("int"))

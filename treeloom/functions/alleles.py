"""Expressions on bases, haplotype strings and statistics of allele counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: The six kinds of changes after folding strands, in the order of the rate matrix.
CHANGES = ("C/A", "C/G", "C/T", "A/T", "A/G", "A/C")


def is_base(c: Column) -> Column:
    return F.coalesce(F.upper(c).isin(*BASES), F.lit(False))


def normal_base(c: Column) -> Column:
    """Upper-case base, N for all else."""
    return F.when(is_base(c), F.upper(c)).otherwise("N")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return complement(F.reverse(s))


def base_at(sequence: Column, pos: Column) -> Column:
    """Upper-case base at a one-based position; null outside."""
    return F.when(pos >= 1, F.nullif(F.upper(F.substring(sequence, pos.cast("int"), F.lit(1))), F.lit("")))


def flip(gt: Column) -> Column:
    return F.translate(gt, "01", "10")


def carriers(gt: Column) -> Column:
    """Number of derived alleles in a haplotype string."""
    return F.length(gt) - F.length(F.translate(gt, "1", ""))


def carries(gt: Column, hap: Column) -> Column:
    """Whether haplotype hap, from 0, is derived."""
    return F.substring(gt, (hap + 1).cast("int"), F.lit(1)) == "1"


def pick(gt: Column, haps: list[int]) -> Column:
    """The haplotypes of a list, in its order."""
    # the list as one literal, not an expression for each haplotype; the string is cut into signs once, not searched for each
    if not len(haps):
        return F.lit("")
    places = F.split(F.lit(",".join(map(str, haps))), ",").cast("array<int>")
    own = lambda signs: F.array_join(F.transform(places, lambda h: F.get(signs, h)), "")
    return F.get(F.transform(F.array(F.split(gt, "")), own), F.lit(0))


def transversion(anc: Column, der: Column) -> Column:
    """True unless both are pyrimidines or both are purines."""
    pair = F.array_join(F.sort_array(F.array(F.upper(anc), F.upper(der))), "")
    return ~pair.isin("CT", "AG")


def well_defined(anc: Column, der: Column, upstream: Column, downstream: Column) -> Column:
    return is_base(anc) & is_base(der) & is_base(upstream) & is_base(downstream) & (F.upper(anc) != F.upper(der))


def context(anc: Column, der: Column, upstream: Column, downstream: Column) -> Column:
    """0 to 95: flanks and change, with G and T read from the other strand; flank pairs first, changes within them."""
    swap = F.upper(anc).isin("G", "T")
    a = F.when(swap, complement(F.upper(anc))).otherwise(F.upper(anc))
    d = F.when(swap, complement(F.upper(der))).otherwise(F.upper(der))
    u = F.when(swap, complement(F.upper(downstream))).otherwise(F.upper(upstream))
    v = F.when(swap, complement(F.upper(upstream))).otherwise(F.upper(downstream))
    change = F.concat(a, F.lit("/"), d)
    kind = F.coalesce(*[F.when(change == c, i) for i, c in enumerate(CHANGES)])
    place = (F.instr(F.lit(BASES), u) - 1) * 4 + (F.instr(F.lit(BASES), v) - 1)
    return F.when(well_defined(anc, der, upstream, downstream), place * 6 + kind).cast("int")


def safe_name(rsid: Column) -> Column:
    return F.translate(rsid, ";", ",")


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (x - mean) / sd)


def log_choose(n: Column, k: Column, log_factorial: Column) -> Column:
    """log C(n, k) from an array of log k!, k = 0, 1, ..."""
    at = lambda i: F.get(log_factorial, i.cast("int"))
    return at(n) - at(k) - at(n - k)


def log_factorials(n: int) -> Column:
    """Array of log k!, k = 0 .. n."""
    import math

    return F.array(*[F.lit(math.lgamma(k + 1)) for k in range(n + 1)])


def selection_log_p(n: int, f_n: Column, k: Column, f_k: Column) -> Column:
    """log10 of the chance that an allele carried by f_k of k lineages reaches f_n or more of n.

    Sum over f of C(f-1, f_k-1) C(n-f-1, k-f_k-1) / C(n-1, k-1); 1 where it isn't defined (f_k under 2 or no k).
    """
    table = log_factorials(n)

    def of(t: Column) -> Column:
        terms = F.transform(
            F.sequence(f_n.cast("int"), (F.lit(n) - k + f_k).cast("int")),
            lambda f: log_choose(f - 1, f_k - 1, t) + log_choose(F.lit(n) - f - 1, k - f_k - 1, t) - log_choose(F.lit(n - 1), k - 1, t),
        )
        terms = F.filter(terms, lambda x: x.isNotNull())  # fewer carriers of n than of k: no way, adds nothing
        top = F.array_max(terms)
        total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return (F.log(total) + top) / F.log(F.lit(10.0))

    defined = (f_k >= 2) & (k >= 0) & (k > f_k) & (f_n <= F.lit(n) - k + f_k)
    return F.when(defined, F.get(F.transform(F.array(table), of), F.lit(0))).otherwise(1.0)


def rsds(ancestral_length: Column, derived_length: Column, n_derived: Column, n: int) -> Column:
    """log((ancestral / derived tip length) * derived) / (n - derived)."""
    return F.log((ancestral_length / derived_length) * n_derived) / (F.lit(n) - n_derived)

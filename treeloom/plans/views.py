"""Genomic tables derived from the star-schema test tables, in Spark and in SQL.

Eight haplotypes a tree, one tree a nation; mutations come from orders, haplotypes from the
signs of embedding components, the genetic map from parts and the mask from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIPS, NODES = 8, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, tree_id, start_snp and nodes: an array of parent, branch_length, num_events, snp_begin, snp_end by label."""
    t = F.col("n_nationkey")

    def node(i):
        level = F.when(i < 8, 0).when(i < 12, 1).when(i < 14, 2).otherwise(3)
        parent = F.when(i == 14, -1).when(i < 8, 8 + F.floor(((3 * i + t) % 8) / 2)).otherwise(8 + F.floor(i / 2)).cast("int")
        length = F.when(i == 14, 0.0).otherwise((1 + (t * 7 + level * 13) % 17).cast("double"))
        begin = (t * 10 + i % 3).cast("int")
        return F.struct(parent.alias("parent"), length.alias("branch_length"), ((t * 3 + i) % 5).cast("float").alias("num_events"), begin.alias("snp_begin"), (begin + 4 + i % 5).cast("int").alias("snp_end"))

    return table(spark, sf_dir, "nation").select((t % 5).cast("int").alias("chrom"), t.cast("int").alias("tree_id"), (t * 10).cast("int").alias("start_snp"), F.transform(F.sequence(F.lit(0), F.lit(NODES - 1)), node).alias("nodes"))


def muts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, chrom, tree_id, pos, branch, anc, der, mask flags and flanks of mutations."""
    k, t = F.col("o_orderkey"), (F.col("o_custkey") % 25)
    base = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "orders").select(
        k.alias("snp_id"),
        (t % 5).cast("int").alias("chrom"),
        t.cast("int").alias("tree_id"),
        (F.floor(t / 5) * 10_000_000 + (k * 97) % 9_999_991).cast("long").alias("pos"),
        (k % 15).cast("int").alias("branch"),
        base(k).alias("anc"),
        base(k + 1 + F.col("o_custkey") % 3).alias("der"),
        base(F.col("o_custkey")).alias("upstream"),
        base(F.floor(F.col("o_custkey") / 4)).alias("downstream"),
        (k % 7 == 0).alias("flipped"),
        F.when(k % 11 == 0, 2).otherwise(1).alias("n_branches"),
    )


def haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, hap, allele: the sign of component snp_id of vector hap."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hap"), F.col("label").alias("grp"), F.posexplode("embedding").alias("snp_id", "x")).select("snp_id", "hap", "grp", (F.col("x") > 0).cast("int").alias("allele"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, snp_id, pos, rsid, anc, alt, gt of the 64 components; gt has a sign 0 or 1 of every vector by vec_id."""
    rows = haps(spark, sf_dir).groupBy("snp_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"].cast("string")), "").alias("gt"))
    base = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    s = F.col("snp_id")
    return rows.select(F.lit(1).alias("chrom"), s, (1000 + 137 * s).cast("long").alias("pos"), F.concat(F.lit("rs"), s.cast("string")).alias("rsid"), base(s).alias("anc"), base(s + 1 + s % 3).alias("alt"), "gt")


def consensus(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """sites of k haplotypes made from all vectors: haplotype h has at each site what most of those with vec_id mod k = h have."""
    rows = haps(spark, sf_dir).groupBy("snp_id", (F.col("hap") % k).alias("hap")).agg((2 * F.sum("allele") > F.count("*")).cast("int").alias("allele"))
    rows = rows.groupBy("snp_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"].cast("string")), "").alias("gt"))
    return sites(spark, sf_dir).drop("gt").join(rows, "snp_id").select("chrom", "snp_id", "pos", "rsid", "anc", "alt", "gt")


def genmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, bp, cm: a rising map, one for each part brand, from running sums of retail prices."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).cast("int").alias("chrom"), (F.col("p_partkey") * 20_000).alias("bp"), "p_partkey", "p_retailprice")
    w = Window.partitionBy("chrom").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("chrom", "bp", (F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).over(w) / 100000.0).alias("cm"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, p (1, 2, ... in the order of events), pass: bases of a mask, true but for errors."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("chrom"), "ts", "event_id", "event_type")
    w = Window.partitionBy("chrom").orderBy("ts", "event_id")
    return e.select("chrom", F.row_number().over(w).alias("p"), (F.col("event_type") != "error").alias("ok"))


#: The same tables for the oracle.
SQL = {
    "nodes": """nodes AS (SELECT CAST(n_nationkey % 5 AS INTEGER) AS chrom, CAST(n_nationkey AS INTEGER) AS tree_id, CAST(i AS INTEGER) AS node,
  CAST(CASE WHEN i = 14 THEN -1 WHEN i < 8 THEN 8 + ((3 * i + n_nationkey) % 8) // 2 ELSE 8 + i // 2 END AS INTEGER) AS parent,
  CASE WHEN i = 14 THEN 0.0 ELSE CAST(1 + (n_nationkey * 7 + 13 * (CASE WHEN i < 8 THEN 0 WHEN i < 12 THEN 1 WHEN i < 14 THEN 2 ELSE 3 END)) % 17 AS DOUBLE) END AS branch_length,
  CAST((n_nationkey * 3 + i) % 5 AS DOUBLE) AS num_events, CAST(n_nationkey * 10 + i % 3 AS INTEGER) AS snp_begin, CAST(n_nationkey * 10 + i % 3 + 4 + i % 5 AS INTEGER) AS snp_end
  FROM nation, range(15) r(i))""",
    "paths": """paths AS (SELECT tree_id, node, node AS above, 0.0::DOUBLE AS far FROM nodes
  UNION ALL SELECT p.tree_id, p.node, n.parent, p.far + n.branch_length FROM paths p JOIN nodes n ON n.tree_id = p.tree_id AND n.node = p.above WHERE n.parent >= 0)""",
    "heights": "heights AS (SELECT tree_id, above AS node, max(far) AS height FROM paths WHERE node < 8 GROUP BY 1, 2)",
    "clades": "clades AS (SELECT tree_id, above AS node, node AS leaf FROM paths WHERE node < 8)",
    "muts": """muts AS (SELECT o_orderkey AS snp_id, CAST(o_custkey % 5 AS INTEGER) AS chrom, CAST(o_custkey % 25 AS INTEGER) AS tree_id,
  CAST((o_custkey % 25) // 5 * 10000000 + (o_orderkey * 97) % 9999991 AS BIGINT) AS pos, CAST(o_orderkey % 15 AS INTEGER) AS branch,
  substr('ACGT', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS anc, substr('ACGT', CAST((o_orderkey + 1 + o_custkey % 3) % 4 + 1 AS INTEGER), 1) AS der,
  substr('ACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS upstream, substr('ACGT', CAST((o_custkey // 4) % 4 + 1 AS INTEGER), 1) AS downstream,
  o_orderkey % 7 = 0 AS flipped, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS n_branches FROM orders)""",
    "dists": "dists AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY chrom ORDER BY pos, snp_id) - pos, 1) AS dist FROM muts)",
    "ages": """ages AS (SELECT m.*, h.height AS age_begin, coalesce(a.height, h.height) AS age_end FROM dists m JOIN nodes n ON n.tree_id = m.tree_id AND n.node = m.branch
  JOIN heights h ON h.tree_id = m.tree_id AND h.node = m.branch LEFT JOIN heights a ON a.tree_id = m.tree_id AND a.node = n.parent)""",
    "haps": "haps AS (SELECT CAST(d - 1 AS INTEGER) AS snp_id, vec_id AS hap, label AS grp, CASE WHEN embedding[d] > 0 THEN 1 ELSE 0 END AS allele FROM embeddings, range(1, 65) r(d))",
    "sites": """sites AS (SELECT 1 AS chrom, snp_id, CAST(1000 + 137 * snp_id AS BIGINT) AS pos, 'rs' || snp_id AS rsid, substr('ACGT', snp_id % 4 + 1, 1) AS anc,
  substr('ACGT', (snp_id + 1 + snp_id % 3) % 4 + 1, 1) AS alt, string_agg(allele::VARCHAR, '' ORDER BY hap) AS gt FROM haps GROUP BY snp_id)""",
    "consensus8": "consensus8 AS (SELECT snp_id, hap % 8 AS hap, CASE WHEN 2 * sum(allele) > count(*) THEN 1 ELSE 0 END AS allele FROM haps GROUP BY 1, 2)",
    "genmap": """genmap AS (SELECT CAST(p_partkey % 5 AS INTEGER) AS chrom, p_partkey * 20000 AS bp,
  sum(CAST(round(p_retailprice * 100) AS BIGINT)) OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) / 100000.0 AS cm FROM part)""",
    "mask": "mask AS (SELECT CAST(user_id % 5 AS INTEGER) AS chrom, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS p, event_type <> 'error' AS ok FROM events)",
    "epochs": "epochs AS (SELECT CAST(e AS INTEGER) AS epoch, e * 5.0 AS lo, CASE WHEN e = 9 THEN 1e9 ELSE (e + 1) * 5.0 END AS hi FROM range(10) r(e))",
}
_NEEDS = {"paths": ["nodes"], "heights": ["paths"], "clades": ["paths"], "dists": ["muts"], "ages": ["dists", "heights"], "sites": ["haps"], "consensus8": ["haps"]}


def sql(query: str, *names: str) -> str:
    """query with the tables that it names, and what they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order) + ("\n" if query.startswith("SELECT") else ",\n") + query

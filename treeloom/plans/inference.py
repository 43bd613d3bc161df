"""From haplotypes to dated genealogies as DataFrame stages.

Sites are cut into chunks; a chunk's haplotypes are one row. Topology is an ordered pass in
a chunk and parallel over chunks; dating is parallel over trees. Stages hand each other
DataFrames, which a caller may write as Parquet to restart from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.kernels import dating, mapping, topology
from treeloom.operators import intervals, trees, windows
from treeloom.operators.trees import Tree

NODES = f"array<{trees.NODE}>"
#: Haplotypes that a task paints of one chunk at a time.
TOGETHER = 32


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores: a row is seconds of work, so that few bytes are no reason to put many into one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def prepare(sites: DataFrame, genmap: DataFrame | None = None, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """sites with dist, rpos, r and state. Without a map a centimorgan is a million bases."""
    rows = windows.distances(sites, by)
    rows = rows.withColumn("rpos", F.col("pos") * 1e-8) if genmap is None else intervals.interpolate(rows, genmap, by)
    rows = windows.recombination(rows, by)
    from treeloom.operators.cleaning import transversions

    return transversions(rows)


def make_chunks(sites: DataFrame, size: int, overlap: int, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """One row for each chunk: its sites in order, with whether each is core. A chunk is bounded by its size."""
    numbered = sites.withColumn("snp", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1)
    last = numbered.agg(F.max("snp")).first()[0]
    rows = windows.chunks(numbered, size, overlap, last or 0, "snp")
    own = F.struct("snp", "snp_id", "pos", "dist", "rpos", "r", "state", "gt", "core")
    return rows.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(own)).alias("sites"))


def paint(chunks: DataFrame, theta: float = 0.001, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(by, chunk, hap, site, topology, log_scale): the posterior of each haplotype at the sites that it visits.

    A row of work is TOGETHER haplotypes of a chunk, which is read once for all of them.
    """
    n = F.length(F.col("sites")[0]["gt"])
    rows = chunks.withColumn("n", n).withColumn("hap", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(TOGETHER))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from treeloom.kernels import painting

        for batch in batches:
            for _, row in batch.iterrows():
                haps, r, _ = _arrays(row["sites"])
                for hap in range(int(row["hap"]), min(int(row["n"]), int(row["hap"]) + TOGETHER)):
                    p = painting.paint(haps, r, hap, theta)
                    yield pd.DataFrame({**{k: row[k] for k in by}, "chunk": row["chunk"], "hap": hap, "site": p.sites, "topology": list(p.topology), "log_scale": p.log_scale})

    head = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in by)
    return rows.mapInPandas(run, f"{head}, chunk int, hap int, site int, topology array<double>, log_scale double")


def _arrays(sites) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    haps = np.array([[c == "1" for c in s["gt"]] for s in sites], int)
    return haps, np.array([s["r"] for s in sites]), np.array([s["rpos"] for s in sites])


def build_topology(chunks: DataFrame, theta: float = 0.001, force_every: int | None = None, consistent: bool = True, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(by, chunk, tree, start_snp, n, nodes, muts) of every chunk; events and spans follow equivalent branches.

    nodes have no lengths yet. muts: snp, snp_id, pos, dist, branches, flipped, core of each site of the tree.
    """
    mut = "struct<snp:int,snp_id:long,pos:long,dist:long,branches:array<int>,flipped:boolean,core:boolean>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                sites = row["sites"]
                haps, r, rpos = _arrays(sites)
                pos = np.array([s["pos"] for s in sites])
                made = topology.build_section(haps, r, rpos, theta, np.array([s["state"] for s in sites]), pos, force_every, consistent)
                events, begin, end = topology.carried(made, len(sites) - 1)
                base = sites[0]["snp"]
                out = []
                for i, t in enumerate(made.trees):
                    nodes = [{"parent": int(t.parent[v]), "branch_length": 0.0, "num_events": float(events[i][v]), "snp_begin": int(base + begin[i][v]), "snp_end": int(base + end[i][v])} for v in range(t.size)]
                    muts = [{"snp": int(s["snp"]), "snp_id": int(s["snp_id"]), "pos": int(s["pos"]), "dist": int(s["dist"]), "branches": [int(b) for b in p.branches], "flipped": bool(p.flipped), "core": bool(s["core"])} for s, p, k in zip(sites, made.placements, made.tree_of, strict=True) if k == i]
                    out.append({**{k: row[k] for k in by}, "chunk": row["chunk"], "tree": i, "start_snp": int(base + made.starts[i]), "n": t.n, "nodes": nodes, "muts": muts})
                yield pd.DataFrame(out)

    head = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in by)
    return _spread(chunks, *by, "chunk").mapInPandas(run, f"{head}, chunk int, tree int, start_snp int, n int, nodes {NODES}, muts array<{mut}>")


def merge_chunks(built: DataFrame, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Trees that have core sites, numbered along the chromosome, with their core mutations only."""
    kept = built.withColumn("muts", F.filter("muts", lambda m: m["core"])).where(F.size("muts") > 0)
    first = F.array_min(F.transform("muts", lambda m: m["snp"]))
    rows = kept.withColumn("start_snp", first)
    # trees stay where they are: their places are numbered and joined back
    place = [*by, "chunk", "tree"]
    numbered = rows.select(*place, (F.row_number().over(Window.partitionBy(*by).orderBy("start_snp")) - 1).cast("int").alias("tree_id"))
    return rows.join(numbered, place).drop("chunk", "tree")


def dated(genealogy: DataFrame, sites: DataFrame, mu: float, ne: float, rates: dating.Rates | None = None, seed: int = 1, samples: int | None = None, ages: list[float] | None = None, most: int | None = None, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """genealogy with branch lengths in generations: posterior means, or `samples` of them in an array column.

    Every tree is a row's work. The seed of a tree is hashed from its place, so that a lost task repeats its result. Bases
    between sites come from sites(by, pos, dist) through the mutations of the trees: spans are bounded by prefix sums.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    run = sites.select(*by, (F.row_number().over(w) - 1).alias("snp"), F.sum("dist").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), "dist")
    run = run.withColumn("before", F.coalesce("before", F.lit(0)))
    # bases from the middle of the gap before snp_begin to the middle of that after snp_end, for every distinct site that a branch starts or ends at
    node = genealogy.select(*by, "tree_id", F.posexplode("nodes").alias("node", "x"))
    a = run.select(*by, F.col("snp").alias("__b"), F.col("before").alias("__lo"))
    left = run.select(*by, (F.col("snp") + 1).alias("__b"), F.col("dist").alias("__prev"))
    z = run.select(*by, F.col("snp").alias("__e"), F.col("before").alias("__hi"), F.col("dist").alias("__own"))
    rows = node.withColumns({"__b": F.col("x.snp_begin"), "__e": F.col("x.snp_end")}).join(a, [*by, "__b"], "left").join(left, [*by, "__b"], "left").join(z, [*by, "__e"], "left")
    bases = F.coalesce("__hi", F.lit(0)) - F.coalesce("__lo", F.lit(0)) + 0.5 * F.coalesce("__own", F.lit(0)) + 0.5 * F.coalesce("__prev", F.lit(0))
    packed = rows.groupBy(*by, "tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", bases.alias("bases")))), lambda s: s["bases"].cast("double")).alias("__bases"))
    scale = 2.0 * ne

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                t = Tree([x["parent"] for x in row["nodes"]], ages=None if ages is None else np.asarray(ages) / scale)
                exposure = np.asarray(row["__bases"], float) * mu * scale
                events = [x["num_events"] for x in row["nodes"]]
                own = int(np.random.SeedSequence([seed, int(row["tree_id"]), *"".join(str(row[k]) for k in by).encode()]).generate_state(1)[0])
                if samples is None:
                    out.append([(dating.posterior_mean(t, events, exposure, rates, own, most) * scale).tolist()])
                else:
                    out.append((dating.posterior_samples(t, events, exposure, samples, rates, own) * scale).tolist())
            yield pd.DataFrame({**{k: batch[k] for k in by}, "tree_id": batch["tree_id"], "__lengths": out})

    types = dict(genealogy.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in by)
    lengths = _spread(genealogy.select(*by, "tree_id", "nodes").join(packed, [*by, "tree_id"]), *by, "tree_id").mapInPandas(go, f"{head}, tree_id int, __lengths array<array<double>>")
    out = genealogy.join(lengths, [*by, "tree_id"])
    first = F.transform("nodes", lambda x, i: x.withField("branch_length", F.get(F.col("__lengths")[0], i)))
    if samples is None:
        return out.withColumn("nodes", first).drop("__lengths")
    return out.withColumn("nodes", first).withColumnRenamed("__lengths", "samples")


def mutations(genealogy: DataFrame, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(by, tree_id, snp, snp_id, pos, dist, branch, n_branches, flipped, age_begin, age_end): ages where one branch carries it."""
    rows = genealogy.select(*by, "tree_id", F.explode("muts").alias("m")).select(*by, "tree_id", "m.*")
    rows = rows.withColumns({"branch": F.when(F.size("branches") == 1, F.col("branches")[0]), "n_branches": F.size("branches")}).drop("core")
    h = trees.with_heights(genealogy.select(*by, "tree_id", "nodes"), [*by, "tree_id"])
    low = h.select(*by, "tree_id", F.col("node").alias("branch"), F.col("height").alias("age_begin"), "parent")
    top = h.select(*by, "tree_id", F.col("node").alias("parent"), F.col("height").alias("__top"))
    out = rows.join(low, [*by, "tree_id", "branch"], "left").join(top, [*by, "tree_id", "parent"], "left")
    return out.withColumn("age_end", F.coalesce("__top", "age_begin")).drop("__top", "parent")


def infer(sites: DataFrame, mu: float, ne: float, genmap: DataFrame | None = None, theta: float = 0.001, chunk: int = 500, overlap: int = 100, rates: dating.Rates | None = None, seed: int = 1, ages: list[float] | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(genealogy, mutations) of clean sites: chunk, paint and build, follow branches, merge, date, annotate."""
    ready = prepare(sites, genmap)
    built = merge_chunks(build_topology(make_chunks(ready, chunk, overlap), theta))
    out = dated(built, ready, mu, ne, rates, seed, ages=ages, most=most)
    return out, mutations(out)


def optimise(chunks: DataFrame, thetas: list[float], scales: list[float], by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(theta, scale, unmapped): sites that don't map with each mutation and recombination parameter; the least is best."""
    grid = chunks.sparkSession.createDataFrame([(a, b) for a in thetas for b in scales], "theta double, scale double")
    rows = chunks.join(F.broadcast(grid))  # a handful of parameters for each chunk

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                haps, r, rpos = _arrays(row["sites"])
                made = topology.build_section(haps, r * row["scale"], rpos, row["theta"])
                yield pd.DataFrame({"theta": [row["theta"]], "scale": [row["scale"]], "unmapped": [sum(p.kind == 3 for p in made.placements)]})

    return rows.mapInPandas(run, "theta double, scale double, unmapped long").groupBy("theta", "scale").agg(F.sum("unmapped").alias("unmapped"))


def map_sites(trees_: DataFrame, sites: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:
    """sites(keys, snp_id, gt) placed on the tree they name: branches, kind and mismatch. One tree's sites are an array."""
    own = sites.groupBy(*keys).agg(F.collect_list(F.struct("snp_id", "gt")).alias("__sites"))

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        out = []
        for s in row["__sites"]:
            p = mapping.place(t, np.array([c == "1" for c in s["gt"]], int))
            out.append((s["snp_id"], p.branches, p.kind, p.mismatch, p.flipped))
        return pd.DataFrame(out, columns=["snp_id", "branches", "kind", "mismatch", "flipped"])

    return trees.map_trees(trees_.join(own, keys), kernel, "snp_id long, branches array<int>, kind int, mismatch int, flipped boolean", keys)


def equivalent_branches(trees_: DataFrame) -> DataFrame:
    """(chrom, tree_id, next_tree_id, branch, next_branch): branches that go on in the next tree of the chromosome."""
    pairs = trees._adjacent(trees_.select("chrom", "tree_id", "nodes"), ["nodes"])

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        link = mapping.equivalent(t, trees.from_nodes(row["next_nodes"]))
        at = np.flatnonzero(link >= 0)
        return pd.DataFrame({"next_tree_id": row["next_tree_id"], "branch": at, "next_branch": link[at]})

    return trees.map_trees(pairs, kernel, "next_tree_id int, branch int, next_branch int", ["chrom", "tree_id"])


def branch_chains(trees_: DataFrame, links: DataFrame) -> DataFrame:
    """(chrom, tree_id, node, chain): one ordered scan of a chromosome's links; links are a few numbers for each branch."""
    sizes = trees_.select("chrom", "tree_id", F.size("nodes").alias("size"))
    own = links.groupBy("chrom", "tree_id").agg(F.collect_list(F.struct("branch", "next_branch")).alias("links"))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tree_id")
        arrays = []
        for _, row in group.iloc[:-1].iterrows():
            a = np.full(row["size"], -1)
            for x in row["links"] if row["links"] is not None else []:
                a[x["branch"]] = x["next_branch"]
            arrays.append(a)
        ids = mapping.chains(arrays, group["size"].tolist())
        return pd.concat([pd.DataFrame({"chrom": row["chrom"], "tree_id": row["tree_id"], "node": np.arange(row["size"]), "chain": x}) for (_, row), x in zip(group.iterrows(), ids, strict=True)])

    return sizes.join(own, ["chrom", "tree_id"], "left").groupBy("chrom").applyInPandas(scan, "chrom int, tree_id int, node int, chain int")


def population_size(genealogy: DataFrame, sites: DataFrame, mu: float, ne: float, bounds: list[float], iterations: int = 10, threshold: float = 0.5, seed: int = 1, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rates, genealogy): the loop that samples branch lengths under the last rates and takes rates from them.

    Badly supported trees are left out of the loop. A round's rates are a few dozen numbers and go through the driver;
    trees stay in Spark and are written to `store` between rounds, which cuts the plan.
    """
    from treeloom.functions.epochs import epochs
    from treeloom.operators import rates as R
    from treeloom.operators import selection

    spark = genealogy.sparkSession
    grid = epochs(spark, bounds, 1e12)
    events = trees.exploded(genealogy.select("chrom", "tree_id", "nodes")).groupBy("chrom", "tree_id").agg(F.sum("num_events").alias("events"))
    good = selection.well_supported(events, threshold).select("chrom", "tree_id")
    loop = genealogy.join(good, ["chrom", "tree_id"], "left_semi")
    spans = windows.tree_spans(mutations(genealogy), ["chrom"])

    def rate_rows(g: DataFrame) -> list:
        h = trees.with_heights(g.select("chrom", "tree_id", "nodes"))
        table = R.total_rates(R.tree_events(h, grid, spans))
        full = grid.join(table, "epoch", "left").withColumn("one", F.lit(1))
        return windows.carried_rates(full.select("one", "epoch", "lo", "rate"), ["one"]).orderBy("epoch").collect()

    found = rate_rows(loop)
    for k in range(iterations):
        now = dating.Rates(np.array([r["lo"] for r in found]) / (2 * ne), np.array([r["rate"] for r in found]) * 2 * ne)
        sampled = dated(loop, sites, mu, ne, now, seed + k, samples=1)
        if store:
            sampled.write.mode("overwrite").parquet(f"{store}/round-{k}")
            sampled = spark.read.parquet(f"{store}/round-{k}")
        found = rate_rows(sampled)
    now = dating.Rates(np.array([r["lo"] for r in found]) / (2 * ne), np.array([r["rate"] for r in found]) * 2 * ne)
    table = spark.createDataFrame([(r["epoch"], float(r["lo"]), float(r["rate"])) for r in found], "epoch int, lo double, rate double")
    return table, dated(genealogy, sites, mu, ne, now, seed)


def clean_stage(spark: SparkSession, path: str) -> None:
    """Removes a stage's folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Differential signal, its combination over comparisons, and enrichment of signatures in profiles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..sources.tables import written
from .ranking import global_position


def long_form(wide: DataFrame, key: str, samples: list[str]) -> DataFrame:
    """(key, sample, value) of a wide matrix."""
    return wide.unpivot([key], samples, "sample", "value")


def expressed(value: Column, group: Column, least: float, share: float, control: str, disease: str) -> Column:
    """Aggregate: whether enough values of either group reach ``least``."""
    of = lambda g: F.coalesce(F.avg(F.when(group == g, (value >= least).cast("double"))), F.lit(0.0))
    return (of(control) >= share) | (of(disease) >= share)


def regulation(change: Column, adjusted: Column, alpha: float, least: float) -> Column:
    """up, down or not_sig; both cutoffs are inclusive, and a null p is not significant."""
    significant = F.coalesce(adjusted <= alpha, F.lit(False))
    return F.when(significant & (change >= least), "up").when(significant & (change <= -least), "down").otherwise("not_sig")


def differential(samples: DataFrame, key: str, control: str, disease: str, floor: float, share: float, alpha: float, least: float) -> DataFrame:
    """Welch test of log2(value + 1) of every key: log2fc, t, dof, p, pass_filter, padj and regulation. samples: (key, group, value).

    The adjustment runs over the keys whose values reach ``floor`` in enough samples of either group; the others have no
    padj and are not_sig. Both groups must have samples.
    """
    of = [F.sum((F.col("group") == g).cast("long")) for g in (control, disease)]
    if not all(samples.agg(*of).first()):
        raise ValueError("a comparison needs samples of both groups")
    logged = samples.withColumn("_log", F.log2(F.col("value") + 1))
    value, group = F.col("_log"), F.col("group")
    out = [f(F.when(group == g, value)).alias(f"{n}_{k}") for k, g in (("control", control), ("disease", disease)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    moments = logged.groupBy(key).agg(*out, expressed(F.col("value"), group, floor, share, control, disease).alias("pass_filter"))
    tested = stats.with_p(stats.welch(moments)).withColumn("log2fc", F.col("mean_disease") - F.col("mean_control"))
    tested = written(tested, "tested")  # tested once, adjusted over a part
    adjusted = stats.bh_adjusted(tested.where("pass_filter").select(key, "p"), "p", key, "padj").select(key, "padj")
    rows = tested.join(adjusted, key, "left")
    return rows.withColumn("regulation", regulation(F.col("log2fc"), F.col("padj"), alpha, least))


def combined(comparisons: list[tuple[str, DataFrame]], control: str, disease: str, floor: float, share: float, alpha: float, least: float) -> DataFrame:
    """The keys that all comparisons find in one direction. comparisons: (name, samples), names unique."""
    names = [n for n, _ in comparisons]
    if len(set(names)) < len(names) or not names:
        raise ValueError("comparisons must be there and have names of their own")
    return consistent([differential(s, "GeneID", control, disease, floor, share, alpha, least) for _, s in comparisons], "GeneID")


def disease_signature(consistent_genes: DataFrame, profile_genes: DataFrame) -> DataFrame:
    """(GeneID, disease_log2FC_mean, disease_direction) of the consistent genes that profiles have, by change and id."""
    rows = consistent_genes.select(F.col("GeneID").cast("string").alias("GeneID"), F.col("log2fc_mean").alias("disease_log2FC_mean")).join(profile_genes.select(F.col("GeneID").cast("string").alias("GeneID")).distinct(), "GeneID", "left_semi")
    return rows.withColumn("disease_direction", F.when(F.col("disease_log2FC_mean") > 0, "up").otherwise("down")).orderBy("disease_log2FC_mean", "GeneID")


def profile_ids(profiles: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(profiles by GeneID, counts): ids that are numbers in more than 95 % of the genes stay, else symbols are mapped and the rest goes; of rows with one id the first stands.

    profiles: long (compound, gene, effect, _ord); dictionary: (symbol, entrez_id).
    """
    genes = profiles.groupBy(text.stripped(F.col("gene").cast("string")).alias("gene")).agg(F.min("_ord").alias("_ord"))
    total, numeric = genes.agg(F.count("*"), F.coalesce(F.avg(F.col("gene").rlike("^[0-9]+$").cast("double")), F.lit(0.0))).first()
    if numeric > 0.95:
        named = genes.withColumn("GeneID", F.col("gene"))
    else:
        named = genes.join(dictionary.select(F.col("symbol").alias("gene"), F.col("entrez_id").alias("GeneID")), "gene")
    named = written(named, "named")
    first = named.groupBy("GeneID").agg(F.min_by("gene", "_ord").alias("gene"), F.count("*").alias("n"))
    mapped, kept, repeated = named.count(), *first.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).first()
    if not kept:
        raise ValueError("no gene of the profiles maps to an id")
    rows = profiles.withColumn("gene", text.stripped(F.col("gene").cast("string"))).join(first.select("gene", "GeneID"), "gene").select("compound", "GeneID", F.col("effect").cast("int").alias("effect"))
    return rows, {"input_gene_count": total, "mapped_gene_count": mapped, "unmapped_gene_count": total - mapped, "duplicate_entrez_row_count": repeated, "entrez_gene_count": kept}


def consistent(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every comparison has as significant in one direction, with mean change and the largest adjusted p."""
    rows = reduce(DataFrame.unionByName, [t.where("regulation <> 'not_sig'").select(key, "log2fc", "padj", "regulation") for t in tables])
    found = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct("regulation").alias("_ways"), F.avg("log2fc").alias("log2fc_mean"), F.avg(F.abs("log2fc")).alias("abs_log2fc_mean"), F.max("padj").alias("padj_max"), F.min("regulation").alias("direction")
    )
    return found.where((F.col("n") == len(tables)) & (F.col("_ways") == 1)).drop("_ways")


def effect_class(probabilities: Column, threshold: float) -> Column:
    """-1, 0 or 1 from three class probabilities: the largest one's class, 0 below the threshold."""
    top = F.array_max(probabilities)
    return F.when(top < threshold, 0).otherwise(F.array_position(probabilities, top).cast("int") - 2)


def enrichment(ranked: DataFrame, profile: str, position: str, hit: Column) -> DataFrame:
    """(profile, es, hits, n): the extreme of the running sum with equal steps for hits and for misses, 0 without hits or without misses.

    ranked: one row per profile and item with its 1-based place; ties of place must not occur. Every profile has a row.
    """
    rows = ranked.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    counts = rows.groupBy(profile).agg(F.sum("_hit").alias("hits"), F.count("*").alias("n"))
    hits = rows.where("_hit = 1").select(profile, position).join(counts, profile).withColumn("_k", F.row_number().over(Window.partitionBy(profile).orderBy(position)))
    misses = F.col("n") - F.col("hits")
    after = F.col("_k") / F.col("hits") - (F.col(position) - F.col("_k")) / misses
    before = (F.col("_k") - 1) / F.col("hits") - (F.col(position) - F.col("_k")) / misses
    both = hits.where("n > hits").groupBy(profile).agg(F.greatest(F.lit(0.0), F.max(after)).alias("_top"), F.least(F.lit(0.0), F.min(before)).alias("_low"))
    es = F.when(F.col("_top") >= -F.col("_low"), F.col("_top")).otherwise(F.col("_low"))
    return counts.join(both, profile, "left").select(profile, F.coalesce(es, F.lit(0.0)).alias("es"), "hits", "n")


def es_of(positions: np.ndarray, n: int) -> float:
    """Enrichment of 0-based hit places among n; 0 without hits or without misses."""
    positions = np.sort(positions)
    h, misses = len(positions), n - len(positions)
    if not h or not misses:
        return 0.0
    before = (positions - np.arange(h)) / misses
    top, low = max(0.0, ((np.arange(h) + 1) / h - before).max()), min(0.0, (np.arange(h) / h - before).min())
    return float(top if top >= -low else low)


def null_moments(sizes: list[int], n: int, draws: int, seed: int) -> dict[int, tuple[float, float]]:
    """Mean and sample deviation of the enrichment of random sets, sizes in ascending order from one stream of numbers."""
    rng, out = np.random.default_rng(seed), {}
    for size in sorted(set(sizes)):
        if size in (0, n):
            out[size] = (0.0, 0.0)
            continue
        es = np.array([es_of(rng.choice(n, size, replace=False), n) for _ in range(draws)])
        out[size] = (float(es.mean()), float(es.std(ddof=1)) if draws > 1 else 0.0)
    return out


def nulls_by_size(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """(n, hits, mean, sd) for each (n, hits) of ``sizes``: each size draws from a stream of its own, so sizes are worked on in parallel."""
    rows = sizes.select(F.col("n").cast("long").alias("n"), F.col("hits").cast("long").alias("hits")).distinct()

    def moments(batches):
        for pdf in batches:
            out = []
            for n, h in zip(pdf["n"].tolist(), pdf["hits"].tolist()):
                rng = np.random.default_rng([seed, n, h])
                es = np.zeros(draws) if h in (0, n) else np.array([es_of(rng.choice(n, h, replace=False), n) for _ in range(draws)])
                out.append((n, h, float(es.mean()), float(es.std(ddof=1)) if draws > 1 else 0.0))
            yield pd.DataFrame(out, columns=["n", "hits", "mean", "sd"])

    return rows.repartition("n", "hits").mapInPandas(moments, "n long, hits long, mean double, sd double")


def digest_nulls(sizes: DataFrame, draws: int) -> DataFrame:
    """(n, hits, mean, sd) for each (n, hits) of ``sizes``, from draws that are orders of digests, so that any engine makes the same.

    Each size draws sets of its own: a draw orders the n places by the digest of (draw, n, hits, place), and the first
    ``hits`` of them are the set. A row holds one draw, so no draw needs a shuffle; an enrichment looks at the hits only.
    """
    sizes = sizes.select(F.col("n").cast("long").alias("n"), F.col("hits").cast("long").alias("hits")).distinct()
    cases = sizes.select("n", "hits", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    cases = cases.repartition(4 * sizes.sparkSession.sparkContext.defaultParallelism, "n", "hits", "draw")  # few rows, much work in each
    kase = F.concat_ws(":", "draw", "n", "hits")
    marks = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda p: F.struct(F.md5(F.concat_ws(":", kase, p).cast("binary")).alias("mark"), p.alias("place")))
    rows = cases.withColumn("at", F.array_sort(F.transform(F.slice(F.array_sort(marks), F.lit(1), F.greatest(F.col("hits").cast("int"), F.lit(0))), lambda x: x["place"])))
    missed = lambda p, i: (p - (i + 1)) / (F.col("n") - F.col("hits"))
    top = F.greatest(F.lit(0.0), F.array_max(F.transform("at", lambda p, i: (i + 1) / F.col("hits") - missed(p, i))))
    low = F.least(F.lit(0.0), F.array_min(F.transform("at", lambda p, i: i / F.col("hits") - missed(p, i))))
    inside = (F.col("hits") > 0) & (F.col("hits") < F.col("n"))
    es = F.when(inside, F.when(top >= -low, top).otherwise(low)).otherwise(0.0)
    return rows.select("n", "hits", es.alias("es")).groupBy("n", "hits").agg(F.avg("es").alias("mean"), F.stddev_samp("es").alias("sd"))


def reversal(es_up: DataFrame, es_down: DataFrame, nulls: DataFrame, profile: str) -> DataFrame:
    """(profile, score): minus the difference of the two enrichments' z scores; a side without hits counts 0.

    es_up, es_down: as ``enrichment`` gives them, every profile in both; nulls: (hits, mean, sd), with n where profiles
    differ in length. There is one null per size, so it is joined as a table.
    """
    keys = ["n", "hits"] if "n" in nulls.columns else ["hits"]
    side = lambda es, name: es.join(nulls, keys, "left").select(profile, stats.zscore(F.col("es"), F.col("mean"), F.col("sd")).alias(name))
    both = side(es_up, "z_up").join(side(es_down, "z_down"), profile, "full")
    return both.select(profile, (-(F.coalesce("z_up", F.lit(0.0)) - F.coalesce("z_down", F.lit(0.0)))).alias("score"))


def scored_profiles(profiles: DataFrame, signature: DataFrame, draws: int, seed: int, one_stream: bool = False) -> DataFrame:
    """(ID, score) of every compound, lower being better: genes of the signature in the order of their change, a compound's raised and lowered genes as hits.

    profiles: (compound, GeneID, effect in -1, 0, 1), all compounds over the same genes; signature: (GeneID,
    disease_log2FC_mean). Genes without a change are left out. one_stream: draw the nulls of all sizes from one stream
    on the driver, sizes ascending, as a fixed result; else each size has its own.
    """
    disease = signature.where("disease_log2FC_mean <> 0").groupBy(F.col("GeneID").cast("string").alias("GeneID")).agg(F.min("disease_log2FC_mean").alias("change"))
    if profiles.where(~F.col("effect").isin(-1, 0, 1)).limit(1).count():
        raise ValueError("effects must be -1, 0 or 1")
    aligned = disease.join(profiles.select(F.col("GeneID").cast("string").alias("GeneID")).distinct(), "GeneID", "left_semi")
    placed = written(global_position(aligned, "change", [F.col("change"), F.col("GeneID")], "place"), "places")
    n = placed.count()
    if not n:
        raise ValueError("signature and profiles have no gene in common")
    rows = profiles.select("compound", F.col("GeneID").cast("string").alias("GeneID"), "effect").join(placed, "GeneID")
    sides = [written(enrichment(rows, "compound", "place", F.col("effect") == s), "enrichment") for s in (1, -1)]
    sizes = sides[0].select("n", "hits").union(sides[1].select("n", "hits")).distinct()
    if one_stream:
        drawn = null_moments([r.hits for r in sizes.collect()], n, draws, seed)  # one row per size
        nulls = rows.sparkSession.createDataFrame([(k, *v) for k, v in drawn.items()], "hits long, mean double, sd double")
    else:
        nulls = written(nulls_by_size(sizes, draws, seed), "nulls")
    return reversal(sides[0], sides[1], nulls, "compound").withColumnRenamed("compound", "ID")


class ProfileModel:
    """Classifiers of a compound's effect on genes, one network per cell line: softmax layers over a fingerprint joined with a gene's features.

    layers: by cell line the (weights, bias) of each layer, rectified but for the last, which has three outputs. The
    arrays come from a file of plain arrays, never from executable code.
    """

    def __init__(self, layers: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.layers = layers

    def probabilities(self, cell_line: str, inputs: np.ndarray) -> np.ndarray:
        x = inputs
        for k, (w, b) in enumerate(self.layers[cell_line]):
            x = x @ w + b
            if k < len(self.layers[cell_line]) - 1:
                x = np.maximum(x, 0)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def predicted_profiles(compounds: DataFrame, features: dict[str, np.ndarray], model: ProfileModel, cell_line: str, threshold: float) -> DataFrame:
    """(compound, gene, effect): -1, 0 or 1 by the most likely class, 0 below the threshold.

    compounds: (compound, fingerprint array<int>); features: a vector per gene, a table of fixed size that goes to all
    workers with the model. Compounds go through in batches; the genes of one compound are one matrix product.
    """
    spark = compounds.sparkSession
    genes = sorted(features)
    told = spark.sparkContext.broadcast((model, genes, np.stack([features[g] for g in genes])))

    def infer(batches):
        own, names, table = told.value
        for pdf in batches:
            for compound, bits in zip(pdf["compound"], pdf["fingerprint"]):
                rows = np.concatenate([np.broadcast_to(np.asarray(bits, float), (len(names), len(bits))), table], axis=1)
                p = own.probabilities(cell_line, rows)
                effect = np.where(p.max(axis=1) < threshold, 0, p.argmax(axis=1) - 1)
                yield pd.DataFrame({"compound": compound, "gene": names, "effect": effect.astype(np.int32)})

    return compounds.select("compound", "fingerprint").mapInPandas(infer, f"compound {dict(compounds.dtypes)['compound']}, gene string, effect int")

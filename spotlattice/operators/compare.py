"""Comparison of groups of spots, signatures, and fields sampled from images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlattice.operators.graph import KEY
from spotlattice.operators.ranks import quantiles


def signature_score(expr: DataFrame, spots: DataFrame, signatures: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample, spot, signature_id, score, genes_used): mean over the available genes, absent values as zero.

    ``signatures`` has an ordered list of names, ``genes`` maps names to genes of the table.
    """
    s = signatures.select("signature_id", F.posexplode("genes").alias("place", "name")).join(genes.select("name", "gene"), "name")
    used = s.groupBy("signature_id").agg(F.count(F.lit(1)).alias("n_used"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("genes_used"))
    total = expr.join(F.broadcast(s.select("signature_id", "gene")), "gene").groupBy(KEY, "spot", "signature_id").agg(F.sum("v").alias("t"))
    full = spots.select(KEY, "spot").join(F.broadcast(used))
    return full.join(total, [KEY, "spot", "signature_id"], "left").select(KEY, "spot", "signature_id", (F.coalesce("t", F.lit(0.0)) / F.col("n_used")).alias("score"), "genes_used")


def signature_contrast(scores: DataFrame, plus: tuple[str, ...], minus: tuple[str, ...]) -> DataFrame:
    """Sum of some signatures less the sum of others, per spot."""
    sign = F.when(F.col("signature_id").isin(*plus), 1.0).when(F.col("signature_id").isin(*minus), -1.0).otherwise(0.0)
    return scores.groupBy(KEY, "spot").agg(F.sum(sign * F.col("score")).alias("contrast"))


def group_compare(rows: DataFrame, keys: tuple[str, ...], side: str, value: str) -> DataFrame:
    """Mean, median and share above zero on both sides and their differences, true side less false side."""
    one = lambda yes: F.when(F.col(side) if yes else ~F.col(side), F.col(value))
    sides = (("b", True), ("a", False))
    g = rows.groupBy(*keys).agg(
        *(x for name, yes in sides for x in (F.count(one(yes)).alias(f"n_{name}"), F.avg(one(yes)).alias(f"mean_{name}"), F.avg((one(yes) > 0).cast("double")).alias(f"positive_{name}")))
    )
    middle = quantiles(rows.filter(F.col(side).isNotNull()).select(*keys, F.col(side).alias("_side"), F.col(value).alias("_value")), (*keys, "_side"), "_value", {"m": 0.5})
    middle = middle.groupBy(*keys).agg(*(F.max(F.when(F.col("_side") == yes, F.col("m"))).alias(f"median_{name}") for name, yes in sides))
    g = g.alias("g").join(middle.alias("m"), reduce(Column.__and__, (F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys)), "left").select("g.*", "median_b", "median_a")
    return g.withColumns({f"delta_{m}": F.col(f"{m}_b") - F.col(f"{m}_a") for m in ("mean", "median", "positive")})


def domain_heatmap(expr: DataFrame, labels: DataFrame, genes: list[int]) -> DataFrame:
    """Mean per gene and domain, z over the domains of a gene (population deviation plus 1e-6); one column a domain."""
    n = labels.groupBy(KEY, "label").agg(F.count(F.lit(1)).alias("n"))
    m = expr.filter(F.col("gene").isin(genes)).join(labels, [KEY, "spot"]).groupBy(KEY, "label", "gene").agg(F.sum("v").alias("s"))
    full = n.join(expr.select("gene").filter(F.col("gene").isin(genes)).distinct()).join(m, [KEY, "label", "gene"], "left").select(KEY, "gene", "label", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    w = Window.partitionBy(KEY, "gene")
    return full.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / (F.stddev_pop("mean").over(w) + 1e-6))


def heatmap_wide(heat: DataFrame, labels: list[int]) -> DataFrame:
    """One row a gene: its mean and its z in each domain, null where the sample has no such domain."""
    one = lambda c, x: F.max(F.when(F.col("label") == x, F.col(c)))
    return heat.groupBy(KEY, "gene").agg(*(one("mean", x).alias(f"domain_{x}_mean_log1p") for x in labels), *(one("z", x).alias(f"domain_{x}_z") for x in labels))


def heatmap_guard(expr: DataFrame, genes: list[int], least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(kept, failures): the expression of the samples with ``least`` of the genes, and a row for each other sample."""
    n = expr.groupBy(KEY).agg(F.count_distinct(F.when(F.col("gene").isin(genes), F.col("gene"))).alias("n_genes"))
    few = n.filter(F.col("n_genes") < least)
    failures = few.withColumns({"failure_type": F.lit("marker_genes"), "error_message": F.concat(F.lit("too few marker genes found: "), "n_genes")})
    return expr.join(F.broadcast(few), KEY, "left_anti"), failures  # one row a sample at most


def coord_label_join(labels: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels by rounded coordinates, and per sample the share of label rows that found a spot; unmatched ones go."""
    at = lambda c: F.bround(c).cast("bigint")
    a = labels.withColumns({"ix": at("x"), "iy": at("y")}).drop("x", "y")
    b = spots.select(KEY, "spot", at("x").alias("ix"), at("y").alias("iy"))
    joined = a.join(b, [KEY, "ix", "iy"], "left")
    return joined.filter("spot IS NOT NULL").drop("ix", "iy"), joined.groupBy(KEY).agg(F.avg(F.col("spot").isNotNull().cast("double")).alias("match_rate"))


def coord_guard(labels: DataFrame, spots: DataFrame, least: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined, rates, failures): ``coord_label_join`` for the samples in which ``least`` of the spots found a label.

    ``rates`` has for each sample n_spots and n_matched, ``failures`` a row for each sample that falls short.
    """
    at = lambda c: F.bround(c).cast("bigint")
    places = labels.select(KEY, at("x").alias("ix"), at("y").alias("iy")).distinct().withColumn("found", F.lit(1))
    seen = spots.select(KEY, at("x").alias("ix"), at("y").alias("iy")).join(places, [KEY, "ix", "iy"], "left")
    rates = seen.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_spots"), F.count("found").alias("n_matched"))
    few = rates.filter(F.col("n_matched") < F.floor(least * F.col("n_spots")))
    message = F.concat(F.lit("label match rate too low: "), "n_matched", F.lit(" of "), "n_spots")
    joined, _ = coord_label_join(labels, spots)
    return joined.join(few, KEY, "left_anti"), rates, few.withColumns({"failure_type": F.lit("label_match"), "error_message": message})


def gray(red, green, blue):
    return 0.2989 * red + 0.5870 * green + 0.1140 * blue


def image_gradient(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(px, py, grad): central differences; the x part is zero in the first and last column, the y part in the first and last row."""
    row, col = Window.partitionBy(*keys, "py").orderBy("px"), Window.partitionBy(*keys, "px").orderBy("py")
    part = lambda w: F.coalesce((F.lead("gray").over(w) - F.lag("gray").over(w)) / 2, F.lit(0.0))
    return pixels.withColumns({"gx": part(row), "gy": part(col)}).withColumn("grad", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def gradient_at_spots(gradient: DataFrame, spots: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The gradient at each spot's nearest pixel (half to even), clipped to the image."""
    size = gradient.groupBy(*keys).agg(F.max("px").alias("mx"), F.max("py").alias("my"))
    s = spots.join(F.broadcast(size), list(keys)) if keys else spots.crossJoin(F.broadcast(size))
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.col(most), F.rint(c).cast("bigint")))
    s = s.select(*spots.columns, at("x", "mx").alias("px"), at("y", "my").alias("py"))
    return s.join(gradient.select(*keys, "px", "py", "grad"), [*keys, "px", "py"])


def edge_alignment(edges: DataFrame, labels: DataFrame, values: DataFrame, least: int = 50) -> DataFrame:
    """Gradient on edges between and within domains, and at boundary and interior spots; samples without an image keep a row."""
    s = labels.join(values.select(KEY, "spot", "grad"), [KEY, "spot"], "left")
    n = s.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_spots"), F.count("grad").alias("n_valued")).filter(F.col("n_spots") >= least)
    a = s.select(KEY, F.col("spot").alias("a"), F.col("label").alias("la"), F.col("grad").alias("ga"))
    b = s.select(KEY, F.col("spot").alias("b"), F.col("label").alias("lb"), F.col("grad").alias("gb"))
    e = edges.join(a, [KEY, "a"]).join(b, [KEY, "b"]).withColumns({"cross": F.col("la") != F.col("lb"), "g": (F.col("ga") + F.col("gb")) / 2})
    of_edges = e.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("cross").cast("bigint")).alias("n_boundary_edges"), F.avg(F.when(F.col("cross"), F.col("g"))).alias("edge_boundary"), F.avg(F.when(~F.col("cross"), F.col("g"))).alias("edge_within"))
    ends = e.select(KEY, F.explode(F.array("a", "b")).alias("spot"), "cross").groupBy(KEY, "spot").agg(F.max(F.col("cross").cast("int")).alias("on"))
    of_spots = s.join(ends, [KEY, "spot"], "left").groupBy(KEY).agg(F.avg(F.when(F.col("on") == 1, F.col("grad"))).alias("spot_boundary"), F.avg(F.when(F.coalesce("on", F.lit(0)) == 0, F.col("grad"))).alias("spot_interior"))
    out = n.join(of_edges, KEY, "left").join(of_spots, KEY, "left")
    return out.withColumns({"delta_edge": F.col("edge_boundary") - F.col("edge_within"), "delta_spot": F.col("spot_boundary") - F.col("spot_interior"), "status": F.when(F.col("n_valued") > 0, "ok").otherwise("missing_image")})


def patch_features(spots: DataFrame, pixels: DataFrame, half: int = 24, least: int = 25, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gray mean, deviation, mean and 95 % quantile of the un-halved inner gradient of the patch about each spot.

    ``keys`` name the columns that tell which image of ``pixels`` a spot lies on; without them there is one image.

    A range join by tiles of the patch's width: a spot looks in the tiles that its
    patch touches, and spots about the same pixel share one search. Grays are added as decimals of six places, so a mean is the same in any order. Spots outside the image and patches with fewer than ``least`` pixels go.
    """
    width = 2 * half + 1
    tile = lambda c: F.floor(c / width)
    keys = list(keys)
    size = pixels.groupBy(*keys).agg(F.max("px").alias("mx"), F.max("py").alias("my"))
    # the neighbours of a pixel are the same in every patch that holds them
    row, col = Window.partitionBy(*keys, "py").orderBy("px"), Window.partitionBy(*keys, "px").orderBy("py")
    beside = {"x0": F.lag("px").over(row), "x1": F.lead("px").over(row), "y0": F.lag("py").over(col), "y1": F.lead("py").over(col)}
    steep = {"gx": F.lead("gray").over(row) - F.lag("gray").over(row), "gy": F.lead("gray").over(col) - F.lag("gray").over(col)}
    p = pixels.select(*keys, "px", "py", "gray").withColumns(beside | steep)
    p = p.select(*keys, "px", "py", "gray", *beside, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("steep"), tile(F.col("px")).alias("tx"), tile(F.col("py")).alias("ty"))
    c = spots.select(KEY, "spot", *(k for k in keys if k != KEY), F.rint("x").cast("bigint").alias("cx"), F.rint("y").cast("bigint").alias("cy"))
    # one image has one row of sizes
    c = (c.join(size, keys) if keys else c.crossJoin(F.broadcast(size))).filter("cx >= 0 AND cy >= 0 AND cx <= mx AND cy <= my")
    tiles = lambda v: F.explode(F.sequence(tile(F.col(v) - half), tile(F.col(v) + half)))
    # spots about one pixel have one patch
    centre = [*keys, "cx", "cy"]
    at = c.select(*centre).distinct().withColumn("tx", tiles("cx")).withColumn("ty", tiles("cy"))
    inside = (F.abs(F.col("px") - F.col("cx")) <= half) & (F.abs(F.col("py") - F.col("cy")) <= half)
    whole = (F.col("x0") >= F.col("cx") - half) & (F.col("x1") <= F.col("cx") + half) & (F.col("y0") >= F.col("cy") - half) & (F.col("y1") <= F.col("cy") + half)
    patch = at.join(p, [*keys, "tx", "ty"]).filter(inside).select(*centre, "gray", F.when(whole, F.col("steep")).alias("g"))
    g = patch.groupBy(*centre).agg(F.count(F.lit(1)).alias("n_pixels"), F.avg(F.col("gray").cast("decimal(18,6)")).cast("double").alias("gray_mean"), F.stddev_pop("gray").alias("gray_sd"), F.avg("g").alias("grad_mean"), F.percentile("g", 0.95).alias("grad_q95"))
    return c.select(KEY, "spot", *(k for k in centre if k != KEY)).join(g.filter(F.col("n_pixels") >= least), centre).select(KEY, "spot", *(x for x in g.columns if x not in centre))

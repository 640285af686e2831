"""Connected components on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id reachable from each vertex.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014): rounds grow with the logarithm of the longest path, not with its
    length. Every step is one aggregation and one join on edge tables; neighbours are reduced with
    ``min`` and never listed, so a vertex with very many neighbours is no special case. Each round
    is checkpointed, because plans over long lineage cannot be recovered after a lost executor.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where(F.col("u") != F.col("v"))
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        large = _star(e, small=False)
        e = cut_lineage(_star(large, small=True))
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    root = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_root"))
    return vertices.select("id").join(root, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def _star(e: DataFrame, small: bool) -> DataFrame:
    """Connect neighbours to the smallest one: larger neighbours (large-star) or the rest (small-star)."""
    if small:
        arcs = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        arcs = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(low, "u")
    if small:
        out = joined.select(F.col("v").alias("x"), "m").union(low.select(F.col("u").alias("x"), "m"))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("x"), "m")
    return out.where(F.col("x") != F.col("m")).select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and degree centrality per vertex."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id")))
    deg = ends.groupBy("id").agg(F.count("*").alias("degree"))
    n = vertices.agg((F.count("*") - 1).alias("_others"))
    out = vertices.select("id").join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.crossJoin(F.broadcast(n)).select(
        "id", "degree", F.coalesce(F.try_divide("degree", "_others"), F.lit(0.0)).alias("centrality"))


def clustering_coefficients(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles and local clustering coefficient per vertex.

    Edges are directed from the lower-degree end to the higher one before wedges are built, so a
    hub opens no wedge of its own: out-degrees stay below sqrt(2 * edges) whatever the skew.
    """
    deg = degrees(vertices, edges).select("id", "degree")
    da = deg.select(F.col("id").alias("a"), F.col("degree").alias("_da"))
    db = deg.select(F.col("id").alias("b"), F.col("degree").alias("_db"))
    und = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct().join(da, "a").join(db, "b")
    first = F.struct("_da", "a") < F.struct(F.col("_db").alias("_da"), F.col("b").alias("a"))
    arcs = und.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    left = arcs.select("u", F.col("v").alias("x"))
    right = arcs.select("u", F.col("v").alias("y"))
    wedges = left.join(right, "u").where(F.col("x") < F.col("y"))
    closing = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    tri = wedges.join(closing, ["x", "y"])
    per = tri.select(F.explode(F.array("u", "x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = deg.join(per, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2.0
    return out.withColumn("coefficient", F.when(F.col("degree") < 2, 0.0).otherwise(F.col("triangles") / pairs))


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Newman modularity of a labelling (id, component) from edge and degree sums."""
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("_ca"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("_cb"))
    e = edges.select("a", "b").join(a, "a").join(b, "b")
    ends = e.select(F.inline(F.array(
        F.struct(F.col("_ca").alias("c"), F.when(F.col("_ca") == F.col("_cb"), 1.0).otherwise(0.0).alias("inside")),
        F.struct(F.col("_cb").alias("c"), F.lit(0.0).alias("inside")))))
    per = ends.groupBy("c").agg(F.sum("inside").alias("l"), F.count("*").alias("d"))
    m = e.agg(F.count("*").alias("m"))
    joined = per.crossJoin(F.broadcast(m))
    return joined.agg(F.coalesce(F.sum(
        F.col("l") / F.col("m") - F.pow(F.col("d") / (2.0 * F.col("m")), F.lit(2))), F.lit(0.0)).alias("modularity"))

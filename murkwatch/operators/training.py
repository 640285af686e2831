"""Training-set preparation and model jobs on Spark ML."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_bits, md5_unit, pin, safe_div
from ..session import cut_lineage
from . import evaluation as ev
from .cosine import by_cell
from .isotonic import isotonic_apply, isotonic_blocks
from .ranking import hash_rank

SEED = "42"


# ---- sets ---------------------------------------------------------------------

def stratified_split(df: DataFrame, key: str, label: str, parts: dict[str, float], seed: str = SEED) -> DataFrame:
    """Append split with exact shares per label, by hash rank within the label."""
    ranked = hash_rank(df, [label], md5_bits(f"split{seed}", key), key)
    out, share = None, 0.0
    for name, p in parts.items():
        share += p
        edge = F.round(F.lit(share) * F.col("total"))
        out = F.when(F.col("rank") <= edge, name) if out is None else out.when(F.col("rank") <= edge, name)
    return ranked.withColumn("split", out.otherwise(list(parts)[-1])).drop("rank", "total")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: str = SEED) -> DataFrame:
    """Append fold 0..k-1; per label, fold sizes differ by at most one."""
    ranked = hash_rank(df, [label], md5_bits(f"fold{seed}", key), key)
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank", "total")


def undersample(df: DataFrame, key: str, label: str, value: int, fraction: float, seed: str = SEED) -> DataFrame:
    """Keep a hash share of one class and all of the others. Narrow."""
    return df.where((F.col(label) != value) | (md5_unit(f"under{seed}", key) < fraction))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Append weight n / (classes * n_class); the counts are one row per class and are broadcast."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    table = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(table), label)


def scale(df: DataFrame, features: list[str], fit_on: Column | None = None) -> DataFrame:
    """Standardise columns with population deviation (0 counts as 1), statistics from ``fit_on`` rows only."""
    part = df.where(fit_on) if fit_on is not None else df
    stats = part.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    sd = lambda c: F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))
    scaled = {c: ((F.col(c) - F.col(f"_mu_{c}")) / sd(c)) for c in features}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


class PointTree:
    """A k-d tree over fixed points: median cuts across the widest side down to leaves, which have bounding boxes.

    A row's k-th distance within its nearest leaf bounds the search; other leaves are read if their box comes as near.
    """

    def __init__(self, at: np.ndarray, leaf: int = 128):
        self.at, self.leaves, parts = at, [], [np.arange(len(at))] if len(at) else []
        while parts:
            part = parts.pop()
            if len(part) <= leaf:
                self.leaves.append(np.sort(part))
                continue
            side = np.argmax(np.ptp(at[part], axis=0))
            part = part[np.argsort(at[part, side], kind="stable")]
            parts += [part[:len(part) // 2], part[len(part) // 2:]]
        self.low = np.array([at[part].min(axis=0) for part in self.leaves])
        self.high = np.array([at[part].max(axis=0) for part in self.leaves])

    def _gaps(self, own: np.ndarray, leaf: int, selves: np.ndarray) -> np.ndarray:
        points = self.leaves[leaf]
        gap = sum((own[:, i, None] - self.at[None, points, i]) ** 2 for i in range(own.shape[1]))
        gap[selves[:, None] == points[None, :]] = np.inf
        return gap

    def boxes_from(self, own: np.ndarray) -> np.ndarray:
        return _box_gaps(own, self.low, self.high)

    def search(self, own: np.ndarray, k: int, selves: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, squared distance, index) of each row's ``k`` nearest points, sorted, ties by index. ``selves`` holds the index of a row's
        own point, which is left out, or -1; ``most`` bounds each row's distances."""
        none = np.zeros(0, np.int64)
        if not self.leaves or not k or not len(own):
            return none, np.zeros(0), none
        box = self.boxes_from(own)
        first, bound = box.argmin(axis=1), np.full(len(own), np.inf) if most is None else most.copy()
        for leaf in np.unique(first):
            rows = np.flatnonzero(first == leaf)
            if len(self.leaves[leaf]) >= k:
                bound[rows] = np.minimum(bound[rows], np.partition(self._gaps(own[rows], leaf, selves[rows]), k - 1, axis=1)[:, k - 1])
        found = [(none, np.zeros(0), none)]
        for leaf, points in enumerate(self.leaves):
            rows = np.flatnonzero(box[:, leaf] <= bound)
            if len(rows):
                gap = self._gaps(own[rows], leaf, selves[rows])
                r, c = np.nonzero((gap <= bound[rows, None]) & (gap < np.inf))
                found.append((rows[r], gap[r, c], points[c]))
        row, gap, point = (np.concatenate(parts) for parts in zip(*found))
        order = np.lexsort((point, gap, row))
        row, gap, point = row[order], gap[order], point[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], gap[kept], point[kept]

    def nearest(self, own: np.ndarray, k: int, selves: np.ndarray) -> list[list[int]]:
        """For each row the indexes of its ``k`` nearest points, nearest first, ties by index."""
        row, _, point = self.search(own, k, selves)
        return [part.tolist() for part in np.split(point, np.searchsorted(row, np.arange(1, len(own))))] if len(own) else []


def _box_gaps(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box. Rounding keeps order, so a box never seems farther than a point in it."""
    return sum(np.maximum(np.maximum(low[None, :, i] - own[:, i, None], own[:, i, None] - high[None, :, i]), 0) ** 2 for i in range(own.shape[1]))


class Cells:
    """Space cut into cells across the widest side of the fullest one, at the median of a few points.

    Every point has a cell, so the points cut with decide only how even the cells are.
    """

    def __init__(self, at: np.ndarray, cells: int):
        # A node is (side, cut, first child); the second child follows the first. Leaves have the side -1 and a cell.
        self.nodes, parts, done = [[-1, 0.0, 0]], [(0, at)], []
        while parts and len(parts) + len(done) < cells:
            parts.sort(key=lambda part: len(part[1]))
            node, part = parts.pop()
            side = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            if not len(part) or part[:, side].min() == part[:, side].max():
                done.append((node, part))
                continue
            value = np.partition(part[:, side], len(part) // 2)[len(part) // 2]
            if value == part[:, side].min():
                value = part[part[:, side] > value, side].min()
            self.nodes[node] = [side, float(value), len(self.nodes)]
            parts += [(len(self.nodes) + i, part[below]) for i, below in enumerate((part[:, side] < value, part[:, side] >= value))]
            self.nodes += [[-1, 0.0, 0], [-1, 0.0, 0]]
        leaves = sorted(node for node, _ in parts + done)
        for cell, node in enumerate(leaves):
            self.nodes[node][2] = cell
        self.count = len(leaves)

    def of(self, own: np.ndarray) -> np.ndarray:
        side, cut, to = (np.array(column) for column in zip(*self.nodes))
        node = np.zeros(len(own), np.int64)
        while (inner := np.flatnonzero(side[node] >= 0)).size:
            at = node[inner]
            node[inner] = to[at] + (own[inner, side[at]] >= cut[at])
        return to[node]


CELL = 100_000  # points per cell, at most about
FOUND = "array<struct<gap:double,tie:bigint,pid:string,copies:bigint,x:array<double>>>"


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _found_column(tree: PointTree, own: np.ndarray, k: int, selves: np.ndarray, most: np.ndarray | None, points: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The neighbours of each row as a column of the type FOUND, and the distance of the last one, infinite where there are fewer than ``k``."""
    row, gap, point = tree.search(own, k, selves, most)
    ends = np.searchsorted(row, np.arange(len(own) + 1))
    last = np.full(len(own), np.inf)
    full = np.flatnonzero(np.diff(ends) == k)
    last[full] = gap[ends[full + 1] - 1] if k else 0.0
    at = pa.array(point)
    fields = {"gap": pa.array(gap), "tie": points["_tie"].take(at), "pid": points["_pid"].take(at), "copies": points["_copies"].take(at), "x": points["_x"].take(at)}
    one = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one), last


def nearest_points(points: DataFrame, width: int, k: int) -> DataFrame:
    """(_x, _found): the ``k`` nearest other points of each of the distinct ``points`` (_x, _tie, _pid, _copies) with ``width`` finite
    coordinates, nearest first, ties by _tie and _pid.

    Exact at any size: points are dealt into cells of bounded size, a task searches a cell by a k-d tree, and a point also asks the cells
    whose bounding box is as near as its k-th neighbour so far. Only cuts and boxes of cells reach the driver.
    """
    n = points.count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    wanted = max(-(-n // CELL), min(2 * cores, n // 2000), 1)
    share = min(1.0, 200 * wanted / max(n, 1))
    some = points.where(F.pmod(F.xxhash64("_x"), F.lit(1 << 20)) < int(share * (1 << 20))).select("_x").collect() if wanted > 1 else []
    cells = Cells(np.array([r["_x"] for r in some], dtype=float).reshape(-1, width), wanted)

    def place(batches):
        for batch in batches:
            yield batch.append_column("cell", pa.array(cells.of(_matrix(batch.column("_x"), width)), pa.int32()))

    columns = "_x array<double>, _tie bigint, _pid string, _copies bigint"
    placed = cut_lineage(points.select("_x", "_tie", "_pid", "_copies").mapInArrow(place, f"{columns}, cell int"))
    sides = placed.groupBy("cell").agg(*[f(F.get("_x", i)) for f in (F.min, F.max) for i in range(width)]).collect()
    numbers = np.array([r[0] for r in sides], dtype=np.int64)
    low, high = (np.array([r[start:start + width] for r in sides], dtype=float).reshape(-1, width) for start in (1, 1 + width))
    tasks = 2 * cells.count
    order = ["cell", "_tie", "_pid", "_x"]

    def at_home(batches):
        for table in by_cell(batches):
            table = table.combine_chunks()
            own, home = _matrix(table["_x"].combine_chunks(), width), table["cell"][0].as_py()
            tree = PointTree(own)
            for start in range(0, len(own), 2048):
                part, selves = own[start:start + 2048], np.arange(start, min(start + 2048, len(own)))
                found, last = _found_column(tree, part, k, selves, None, table)
                near = (_box_gaps(part, low, high) <= last[:, None]) & (numbers != home)[None, :]
                row, cell = np.nonzero(near)
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[cell], pa.int32()))
                yield pa.RecordBatch.from_arrays([table["_x"].slice(start, 2048).combine_chunks(), found, others, pa.array(last)], names=["_x", "_found", "_cells", "_most"])

    home = cut_lineage(placed.repartition(tasks, "cell").sortWithinPartitions(*order).mapInArrow(
        at_home, f"_x array<double>, _found {FOUND}, _cells array<int>, _most double"))
    asks = home.select(F.explode("_cells").alias("cell"), "_x", "_most")

    def abroad(batches):
        held, tree, points_, where = [], None, None, None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            asking = batch.column("_most").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(asking.astype(np.int8)) != 0)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if where != cell[a]:
                    held, tree, where = [], None, cell[a]
                if not asking[a]:
                    held.append(part)
                    continue
                if tree is None:
                    points_ = pa.Table.from_batches(held).combine_chunks()
                    tree = PointTree(_matrix(points_["_x"].combine_chunks(), width))
                for start in range(0, len(part), 2048):
                    some_ = part.slice(start, 2048)
                    found, _ = _found_column(tree, _matrix(some_.column("_x"), width), k, np.full(len(some_), -1), some_.column("_most").to_numpy(), points_)
                    yield pa.RecordBatch.from_arrays([some_.column("_x"), found], names=["_x", "_found"])

    # A cell's points come first, then the rows that ask there, which are read batch by batch.
    sent = placed.withColumn("_most", F.lit(None).cast("double")).unionByName(asks, allowMissingColumns=True)
    away = sent.repartition(tasks, "cell").sortWithinPartitions("cell", "_most", *order[1:]).mapInArrow(abroad, f"_x array<double>, _found {FOUND}")
    asked = F.size("_cells") > 0
    both = home.where(asked).select("_x", "_found").unionByName(away).groupBy("_x").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_found"))), 1, k).alias("_found"))
    return home.where(~asked).select("_x", "_found").unionByName(both)


def smote(df: DataFrame, key: str, label: str, features: list[str], minority: int = 1, k: int = 5, seed: str = SEED) -> DataFrame:
    """Append synthetic minority rows until both classes are equal.

    Each minority row is interpolated with one of its ``k`` nearest among all others of its label, found exactly (``nearest_points``). A row
    without another point, or with a value that is null or not finite, is interpolated with itself. Each base row is used floor or ceil of
    (missing / minority) times.
    """
    rows = df.where(F.col(label) == minority).select(
        F.col(key).alias("_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    # Equal rows are one point with a count.
    points = cut_lineage(rows.groupBy("_x").agg(F.count("*").alias("_copies"), F.min(F.col("_id").cast("string")).alias("_pid")))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    known = points.where(finite).withColumn("_tie", md5_bits("fit" + seed, "_pid"))
    near = F.flatten(F.transform("_found", lambda p: F.array_repeat(p["x"], F.least(p["copies"], F.lit(k)).cast("int"))))
    others = nearest_points(known, len(features), k).select("_x", near.alias("_others"))
    own = F.array_repeat("_x", F.least(F.col("_copies") - 1, F.lit(k)).cast("int"))
    hoods = points.select("_x", "_copies").join(others, "_x", "left").select("_x", F.slice(F.concat(
        own, F.coalesce("_others", F.array().cast("array<array<double>>"))), 1, k).alias("_near"))
    counts = df.agg(F.count_if(F.col(label) == minority).alias("_m"), F.count_if(F.col(label) != minority).alias("_o"))
    ranked = hash_rank(rows.select("_id", "_x").withColumn("_one", F.lit(1)), ["_one"], md5_bits(f"smote{seed}", "_id"), "_id")
    base = ranked.join(hoods, "_x").crossJoin(F.broadcast(counts))
    missing = F.greatest(F.lit(0), F.col("_o") - F.col("_m"))
    copies = F.floor(missing / F.col("_m")) + F.when(F.col("rank") <= F.pmod(missing, F.col("_m")), 1).otherwise(0)
    made = base.withColumn("_c", copies.cast("int")).where(F.col("_c") > 0).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    pick = F.coalesce(F.get("_near", F.pmod(md5_bits("pick" + seed, "_id", "_i"), F.greatest(
        F.size(F.coalesce("_near", F.array())), F.lit(1))).cast("int")), F.col("_x"))
    made = pin(made, {"_p": pick, "_u": md5_unit("gap" + seed, "_id", "_i")})
    mix = F.zip_with("_x", "_p", lambda a, b: a + F.col("_u") * (b - a))
    synth = pin(made, {"_s": mix}).select(
        F.concat(F.lit("smote-"), F.col("_id").cast("string"), F.lit("-"), F.col("_i").cast("string")).alias(key),
        F.lit(minority).alias(label), *[F.get("_s", i).alias(c) for i, c in enumerate(features)])
    real = df.select(F.col(key).cast("string").alias(key), label, *features)
    return real.withColumn("synthetic", F.lit(False)).unionByName(synth.withColumn("synthetic", F.lit(True)))


# ---- models ---------------------------------------------------------------------

NODE_IDS_MB = 128  # of cached node ids for each core


class Forest(RandomForestClassifier):
    """A random forest that keeps each row's node in every tree between levels, where these numbers are small enough to stay in memory.

    The trees are the same either way; without the numbers every level follows all trees from their roots again.
    """

    def _fit(self, dataset: DataFrame):
        size = dataset.count() * self.getNumTrees() * 4
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        kept = self.copy().setCacheNodeIds(size <= cores * NODE_IDS_MB << 20)
        return super(Forest, kept)._fit(dataset)


def candidates(features: list[str], label: str = "label", weight: str | None = None, trees: int = 200) -> dict[str, Pipeline]:
    """LR, RF (depth 15) and GBT (depth 5) pipelines over assembled, scaled features."""
    extra = {"weightCol": weight} if weight else {}
    head = [VectorAssembler(inputCols=features, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    return {
        "LR": Pipeline(stages=head + [LogisticRegression(labelCol=label, **extra)]),
        "RF": Pipeline(stages=head + [Forest(labelCol=label, numTrees=trees, maxDepth=15, seed=42, **extra)]),
        "GBT": Pipeline(stages=head + [GBTClassifier(labelCol=label, maxIter=trees, maxDepth=5, seed=42, **extra)]),
    }


def scores(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """Probability of the positive class next to the kept columns."""
    return model.transform(df).select(*keep, F.get(vector_to_array("probability"), 1).alias("p"))


def metrics_at(df: DataFrame, label: str = "label", p: str = "p", cut: float = 0.5) -> DataFrame:
    """F1, precision, recall, MCC and AUC of probabilities."""
    m = ev.confusion(df, F.col(label) == 1, F.col(p) >= cut).withColumns(ev.metric_columns())
    return m.crossJoin(F.broadcast(ev.auc(df, label, p))).select("support", "f1", "precision", "recall", "mcc", "auc")


def compare_models(train: DataFrame, test: DataFrame, models: dict[str, Pipeline], label: str = "label") -> DataFrame:
    """One metric row per model; fits run one after the other, each distributed."""
    out = None
    for name, pipe in models.items():
        row = metrics_at(scores(pipe.fit(train), test, [label]), label).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("f1"), "model").limit(1)


FOLD_METRICS = ["f1", "precision", "recall", "mcc", "auc", "log_loss"]


def fold_metrics(df: DataFrame, key: str, features: list[str], models: dict[str, Pipeline], label: str = "label", k: int = 5,
                 parallel: int = 5, minority: int = 1) -> DataFrame:
    """One metric row per (model, fold): fitted on the other folds, balanced by ``smote``, scored on the fold's own rows.

    Rows are scaled and dealt into folds once and stored; all fits read that table, ``parallel`` of them at a time. No
    synthetic row is scored. The driver holds the fitted models only.
    """
    rows = scale(df.select(key, label, *features), features)
    held = cut_lineage(stratified_folds(rows, key, label, k).withColumn(key, F.col(key).cast("string")))

    def balanced(fold: int) -> DataFrame:
        rest = held.where(F.col("fold") != fold)
        return cut_lineage(smote(rest, key, label, features, minority).select(label, *features))

    def fitted(name: str, fold: int, train: DataFrame):
        own = held.where(F.col("fold") == fold)
        return scores(models[name].copy().fit(train), own, [label]).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), label, "p")

    spark = df.sparkSession
    with ThreadPool(parallel) as pool:
        trains = pool.map(inheritable_thread_target(spark)(balanced), range(k))
        # The slowest kind of model first, so that the last fits are short.
        work = [(name, fold, trains[fold]) for name in reversed(models) for fold in range(k)]
        parts = pool.map(inheritable_thread_target(spark)(lambda one: fitted(*one)), work, chunksize=1)
    scored = cut_lineage(reduce(DataFrame.unionByName, parts))
    by = ["model", "fold"]
    m = ev.confusion(scored, F.col(label) == 1, F.col("p") >= 0.5, by).withColumns(ev.metric_columns())
    return m.join(ev.auc(scored, label, "p", by), by).join(ev.log_loss(scored, label, "p", by), by).select(*by, "support", *FOLD_METRICS)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric per model over its folds; ``best`` marks the highest mean F1, ties by name."""
    out = metrics.groupBy("model").agg(
        F.count("*").alias("folds"), F.sum("support").alias("support"),
        *[f(c).alias(c + tail) for c in FOLD_METRICS for f, tail in ((F.avg, ""), (F.stddev_pop, "_sd"))])
    top = best_model(out).select(F.col("model").alias("_top"))
    return out.crossJoin(F.broadcast(top)).withColumn("best", F.col("model") == F.col("_top")).drop("_top")


def calibrate_isotonic(held_out: DataFrame, target: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Append calibrated: isotonic fit on held-out probabilities applied to ``target``."""
    return isotonic_apply(target, isotonic_blocks(held_out, p, label), p)


def calibrate_platt(held_out: DataFrame, target: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Append calibrated: one-feature logistic fit on held-out probabilities."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="_pv"),
                            LogisticRegression(featuresCol="_pv", labelCol=label, rawPredictionCol="_pr",
                                               probabilityCol="_pp", predictionCol="_pd")])
    out = pipe.fit(held_out).transform(target)
    return out.withColumn("calibrated", F.get(vector_to_array("_pp"), 1)).drop("_pv", "_pr", "_pp", "_pd")


def soft_vote(df: DataFrame, probabilities: list[str]) -> DataFrame:
    mean = sum(F.col(c) for c in probabilities) / len(probabilities)
    return df.withColumn("p", mean).withColumn("vote", (F.col("p") >= 0.5).cast("int"))


def meta_learner(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Coefficients of a logistic model over module probabilities and their share in percent."""
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"),
                             LogisticRegression(labelCol=label)]).fit(df).stages[-1]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("coefficient"))
                      for c, w in zip(columns, model.coefficients)])
    rows = df.sparkSession.range(1).select(F.inline(pairs))
    total = F.sum(F.abs("coefficient")).over(Window.partitionBy(F.lit(0)))  # one row per module
    return rows.withColumn("share_pct", safe_div(F.abs("coefficient"), total) * 100)


def feature_importance(model, features: list[str], spark) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("importance"))
                      for c, w in zip(features, model.featureImportances)])
    return spark.range(1).select(F.inline(pairs)).orderBy(F.desc("importance"), "feature")


def column_ablation(train: DataFrame, test: DataFrame, subsets: dict[str, list[str]], full: str, label: str = "label") -> DataFrame:
    """Metrics per column subset and the difference to the full model; test rows are never trained on."""
    models = {n: Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), LogisticRegression(labelCol=label)])
              for n, cols in subsets.items()}
    m = compare_models(train, test, models, label).withColumnRenamed("model", "subset")
    base = m.where(F.col("subset") == full).select(
        F.col("f1").alias("_f1"), F.col("auc").alias("_auc"), F.col("mcc").alias("_mcc"))
    return m.crossJoin(F.broadcast(base)).select(
        "subset", "f1", "auc", "mcc", (F.col("f1") - F.col("_f1")).alias("delta_f1"),
        (F.col("auc") - F.col("_auc")).alias("delta_auc"), (F.col("mcc") - F.col("_mcc")).alias("delta_mcc"))


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of ``low`` to ``high`` characters of the lower-cased text, a space at either end; null has those of the empty text."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))

    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(F.length(padded) < n, F.array().cast("array<string>")).otherwise(runs)

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def with_ngram_weights(train: DataFrame, test: DataFrame, text: str, out: str = "ngrams", slots: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Append a sparse vector of hashed character n-gram counts times inverse document frequency, which comes from ``train`` only.

    Counts of n-grams in one slot add up; only ``slots`` document counts reach the driver.
    """
    counts = HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=slots)
    weigh = lambda df: counts.transform(df.withColumn("_grams", char_ngrams(F.col(text)))).drop("_grams")
    left, right = weigh(train), weigh(test)
    idf = IDF(inputCol="_counts", outputCol=out).fit(left)
    return idf.transform(left).drop("_counts"), idf.transform(right).drop("_counts")


def cross_grid(sets: dict[str, tuple[DataFrame, DataFrame]], features: list[str], label: str = "label") -> DataFrame:
    """Train on each set, test on each set."""
    out = None
    for source, (train, _) in sets.items():
        model = candidates(features, label)["LR"].fit(train)
        for target, (_, test) in sets.items():
            row = metrics_at(scores(model, test, [label]), label).select(
                F.lit(source).alias("trained_on"), F.lit(target).alias("tested_on"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def harden(train: DataFrame, test: DataFrame, features: list[str], columns: list[str], key: str, label: str = "label",
           epsilon: float = 0.1, share: float = 0.3) -> DataFrame:
    """Adversarial augmentation: perturb a hash share of the training rows, refit, compare attack success."""
    def fit(rows: DataFrame) -> ev.LinearRule:
        lr = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                              LogisticRegression(labelCol=label)]).fit(rows).stages[-1]
        return ev.LinearRule(float(lr.intercept), dict(zip(features, map(float, lr.coefficients))))

    def asr(rule: ev.LinearRule) -> DataFrame:
        moved = ev.sign_step(test, label, rule, [epsilon], columns)
        return ev.attack_success(moved, label, F.col("pred_before"), rule.decide()).select("asr")

    def f1(rule: ev.LinearRule) -> DataFrame:
        return ev.confusion(test, F.col(label) == 1, rule.decide()).withColumns(ev.metric_columns()).select("f1")

    before = fit(train)
    picked = train.where(md5_unit("harden", key) < share)
    moved = ev.sign_step(picked, label, before, [epsilon], columns).select(*train.columns)
    after = fit(train.unionByName(moved))
    row = asr(before).withColumnRenamed("asr", "asr_before").crossJoin(asr(after).withColumnRenamed("asr", "asr_after"))
    row = row.crossJoin(f1(before).withColumnRenamed("f1", "f1_before")).crossJoin(f1(after).withColumnRenamed("f1", "f1_after"))
    return row.withColumn("asr_reduction_pct", safe_div(
        F.col("asr_before") - F.col("asr_after"), F.col("asr_before")) * 100).withColumn(
        "f1_cost", F.col("f1_before") - F.col("f1_after"))


# ---- text rows -----------------------------------------------------------------

INSTRUCTION = "Explain the findings below to a reviewer."


def instruction_rows(df: DataFrame, title: str, subject: str, indicators: str = "indicators") -> DataFrame:
    """Append instruction, input and output text built from an analysed row."""
    lines = F.array_join(F.transform(indicators, lambda h: F.concat(h["rule"], F.lit(": "), h["detail"])), ", ")
    verdict = F.when(F.col("risk_score") > 60, "FRAUDULENT").when(F.col("risk_score") > 30, "SUSPICIOUS").otherwise("GENUINE")
    return df.withColumns({
        "instruction": F.lit(INSTRUCTION),
        "input": F.concat(F.lit(f"{title}:\n- Subject: "), F.coalesce(F.col(subject), F.lit("unknown")),
                          F.lit("\n- Risk Score: "), F.col("risk_score").cast("string"), F.lit("\n- Indicators: "), lines),
        "output": F.concat(F.lit("VERDICT: "), verdict, F.lit("\nCONFIDENCE: "), F.greatest(
            F.col("risk_score"), 100 - F.col("risk_score")).cast("string"), F.lit("%\nINDICATORS: "), F.size(indicators).cast("string")),
    })


def parse_report(df: DataFrame, text: str) -> DataFrame:
    """Append verdict, confidence, attack_type and analyst_note from KEY: value lines; defaults when absent.

    The last line of a key counts, keys are compared without case.
    """
    def last(key: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
        return F.trim(F.try_element_at(found, F.lit(-1)))

    conf = F.trim(F.replace(last("CONFIDENCE"), F.lit("%"), F.lit(""))).try_cast("int")
    return df.withColumns({
        "verdict": F.coalesce(last("VERDICT"), F.lit("SUSPICIOUS")), "confidence": F.coalesce(conf, F.lit(50)),
        "attack_type": F.coalesce(last("ATTACK_TYPE"), F.lit("Unknown Attack")),
        "analyst_note": F.coalesce(last("ANALYST_NOTE"), F.lit("Analysis incomplete.")),
    })

"""Concept drift on a stream of prediction errors.

Batch functions answer "where is the first signal since the start (or the last reset)?" with
two-level running sums over time slices, so that one busy module is spread over many tasks. The
streaming operator keeps a small state per module and goes on after each detection.
"""

from __future__ import annotations

import math
from collections import deque
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

SLICE_SECONDS = 21_600
WINDOW = 500
ACTIVE = 200
# Detector parameters. The Page-Hinkley sum is kept without a forgetting factor, so that it has a batch form.
DDM_MIN, DDM_WARN, DDM_DRIFT = 30, 2.0, 3.0
PH_MIN, PH_DELTA, PH_LAMBDA = 30, 0.005, 50.0
ADWIN_DELTA, ADWIN_CLOCK, ADWIN_BUCKETS, ADWIN_MIN_WINDOW, ADWIN_GRACE = 0.002, 32, 5, 5, 10


def _slices(df: DataFrame) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (SLICE_SECONDS * 1_000_000)))


def numbered(df: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Append n (1-based position) and total_errors (errors up to and with the row) per module."""
    base = _slices(df)
    sizes = base.groupBy("module", "_slice").agg(F.count("*").alias("_n"), F.sum("error").alias("_e"))
    before = Window.partitionBy("module").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "module", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_e").over(before), F.lit(0)).alias("_e0"))
    inside = Window.partitionBy("module", "_slice").orderBy(*order)
    local = base.select("*", F.row_number().over(inside).alias("_i"), F.sum("error").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    joined = local.join(offsets, ["module", "_slice"])
    return joined.select(
        *df.columns, "_slice", (F.col("_n0") + F.col("_i")).alias("n"), (F.col("_e0") + F.col("_s")).alias("total_errors"))


def _running(df: DataFrame, specs: dict[str, tuple[Column, str]]) -> DataFrame:
    """Append running values per module over n: name -> (column, "min" | "max" | "sum"), in two levels.

    All columns share one aggregation, one window and one join.
    """
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    base = df.withColumns({f"_v_{k}": v for k, (v, _) in specs.items()})
    per = base.groupBy("module", "_slice").agg(*[fold[how](f"_v_{k}").alias(f"_p_{k}") for k, (_, how) in specs.items()])
    before = Window.partitionBy("module").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("module", "_slice", *[fold[how](f"_p_{k}").over(before).alias(f"_o_{k}") for k, (_, how) in specs.items()])
    inside = Window.partitionBy("module", "_slice").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = base.select(*df.columns, *[fold[how](f"_v_{k}").over(inside).alias(f"_l_{k}") for k, (_, how) in specs.items()])

    def both(k: str, how: str) -> Column:
        a, b = F.col(f"_l_{k}"), F.col(f"_o_{k}")
        if how == "sum":
            return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
        return F.least(a, b) if how == "min" else F.greatest(a, b)

    joined = local.join(offsets, ["module", "_slice"])
    return joined.select(*df.columns, *[both(k, how).alias(k) for k, (_, how) in specs.items()])


def error_rates(stream: DataFrame, window: int = WINDOW) -> DataFrame:
    """Append error_rate_current (last ``window``), error_rate_baseline (first ``window``) and delta.

    The rolling sum is the difference of two running totals, ``window`` positions apart: an
    equi-join on position instead of a frame over a whole module.
    """
    rows = numbered(stream) if "n" not in stream.columns else stream
    past = rows.select("module", (F.col("n") + window).alias("n"), F.col("total_errors").alias("_past"))
    first = rows.where(F.col("n") <= window).select("module", F.col("n").alias("_bn"), F.col("total_errors").alias("_be"))
    # At most ``window`` rows per module; the last of them is the finished baseline.
    done = first.groupBy("module").agg(F.max("_bn").alias("_fn"), F.max_by("_be", "_bn").alias("_fe"))
    j = rows.join(past, ["module", "n"], "left").join(done, "module")
    size = F.least("n", F.lit(window))
    current = (F.col("total_errors") - F.coalesce("_past", F.lit(0))) / size
    baseline = F.when(F.col("n") < F.col("_fn"), F.col("total_errors") / F.col("n")).otherwise(F.col("_fe") / F.col("_fn"))
    return j.withColumns({"error_rate_current": current, "error_rate_baseline": baseline}).withColumn(
        "delta", F.col("error_rate_current") - F.col("error_rate_baseline")).drop("_past", "_fn", "_fe")


def ddm(rows: DataFrame) -> DataFrame:
    """Append ddm_warning and ddm_drift without resets (Gama et al., 2004) to numbered rows."""
    p = F.col("total_errors") / F.col("n")
    s = F.sqrt(p * (1 - p) / F.col("n"))
    ready = F.col("n") >= DDM_MIN
    level = F.when(ready & (F.col("total_errors") > 0), F.struct((p + s).alias("level"), p.alias("p"), s.alias("s")))
    out = _running(rows, {"_best": (level, "min")})
    now = p + s
    known = ready & F.col("_best").isNotNull()
    drift = F.coalesce(known & (now > F.col("_best.p") + DDM_DRIFT * F.col("_best.s")), F.lit(False))
    warn = F.coalesce(known & (now > F.col("_best.p") + DDM_WARN * F.col("_best.s")), F.lit(False))
    return out.withColumns({"ddm_drift": drift, "ddm_warning": warn & ~drift}).drop("_best")


def page_hinkley(rows: DataFrame, delta: float = PH_DELTA, threshold: float = PH_LAMBDA) -> DataFrame:
    """Append ph_drift without resets (Page, 1954): rise of sum(x - mean - delta) over its minimum.

    The increments need the running mean only, which numbered rows already carry.
    """
    step = F.col("error") - F.col("total_errors") / F.col("n") - F.lit(delta)
    summed = _running(rows, {"ph_sum": (step, "sum")})
    out = _running(summed, {"_low": (F.col("ph_sum"), "min")})
    rise = F.col("ph_sum") - F.least("_low", F.lit(0.0))
    return out.withColumn("ph_drift", (F.col("n") >= PH_MIN) & (rise > threshold)).drop("_low")


def adwin(rows: DataFrame, delta: float = ADWIN_DELTA, clock: int = ADWIN_CLOCK) -> DataFrame:
    """(module, adwin_at): position of the first adaptive-window signal (Bifet and Gavaldà, 2007) of numbered rows.

    Errors are summed per chunk of ``clock`` rows. At each chunk's end the window is cut before its last 1, 2, 4, ...
    chunks, as an exponential histogram cuts it, so n rows give n / clock * log n comparisons, each an equi-join of two
    running totals. Modules without a signal have no row.
    """
    ends = cut_lineage(rows.where(F.col("n") % clock == 0).select("module", (F.col("n") / clock).cast("long").alias("c"), F.col("total_errors").alias("s")))
    sizes = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("c") - 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("long"))
    cuts = ends.where("c > 1").select("module", "c", "s", F.explode(sizes).alias("tail")).withColumn("_cut", F.col("c") - F.col("tail"))
    met = cuts.join(ends.select("module", F.col("c").alias("_cut"), F.col("s").alias("s0")), ["module", "_cut"])
    n, n0, n1 = F.col("c") * clock, F.col("_cut") * clock, F.col("tail") * clock
    share = F.col("s") / n
    log = F.log(2.0 * F.log(n.cast("double")) / delta)
    inverse = 1.0 / (n0 - ADWIN_MIN_WINDOW + 1) + 1.0 / (n1 - ADWIN_MIN_WINDOW + 1)
    bound = F.sqrt(2.0 * inverse * share * (1.0 - share) * log) + 2.0 / 3.0 * inverse * log
    found = met.where(F.abs(F.col("s0") / n0 - (F.col("s") - F.col("s0")) / n1) > bound)
    return found.groupBy("module").agg((F.min("c") * clock).alias("adwin_at"))


def first_votes(rows: DataFrame) -> DataFrame:
    """Numbered rows with adwin, ph and ddm true where that detector signals first, and ddm_warning."""
    both = cut_lineage(page_hinkley(ddm(rows)).select("module", "n", "_slice", "ddm_warning", "ddm_drift", "ph_drift"))
    firsts = both.groupBy("module").agg(
        F.min(F.when(F.col("ddm_drift"), F.col("n"))).alias("_ddm"), F.min(F.when(F.col("ph_drift"), F.col("n"))).alias("_ph"))
    marked = both.join(firsts.join(adwin(rows), "module", "left"), "module")
    at = lambda c: F.coalesce(F.col("n") == F.col(c), F.lit(False))
    return marked.select("module", "n", "_slice", "ddm_warning", at("_ddm").alias("ddm"), at("_ph").alias("ph"), at("adwin_at").alias("adwin"))


def majority_vote(votes: DataFrame, active: int = ACTIVE) -> DataFrame:
    """Append status and action to rows (module, n, _slice, adwin, ph, ddm, ddm_warning).

    A vote stays active for ``active`` rows after it was cast.
    """
    # The input is read by several joins below, so it is written once.
    names = ("adwin", "ph", "ddm")
    out = _running(cut_lineage(votes), {f"_last_{d}": (F.when(F.col(d), F.col("n")), "max") for d in names})
    count = sum(
        F.when(F.col("n") - F.col(f"_last_{d}") <= active, 1).otherwise(0) for d in names)
    out = out.withColumn("active_votes", count)
    status = F.when(F.col("active_votes") >= 2, "drift").when(
        (F.col("active_votes") == 1) | F.col("ddm_warning"), "warning").otherwise("stable")
    action = F.when(F.col("status") == "drift", "retrain").when(F.col("status") == "warning", "alert").otherwise("monitor")
    out = out.withColumn("status", status).withColumn("action", action)
    first = {"drift_detected_at": (F.when(F.col("status") == "drift", F.col("n")), "min")}
    return _running(out.drop("_last_adwin", "_last_ph", "_last_ddm"), first)


def detection_report(signals: DataFrame, detectors: list[str], by: str = "module") -> DataFrame:
    """First detection, delay and earlier false alarms per detector: (module, detector, ...).

    ``signals`` carries drift_point, the position of the change in the row's stream.
    """
    drift_point = F.col("drift_point")
    long = signals.select(by, "n", "drift_point", F.inline(F.array(*[
        F.struct(F.lit(d).alias("detector"), F.col(d).alias("fired")) for d in detectors])))
    out = long.groupBy(by, "drift_point", "detector").agg(
        F.min(F.when(F.col("fired") & (F.col("n") >= drift_point), F.col("n"))).alias("detected_at"),
        F.count_if(F.col("fired") & (F.col("n") < drift_point)).alias("false_alarms"))
    return out.withColumn("delay", F.col("detected_at") - drift_point).drop("drift_point")


# ---- keyed stream state -------------------------------------------------------------------

class Adwin:
    """Adaptive window over bounded values (Bifet & Gavaldà, 2007) as exponential buckets.

    Level k holds at most five buckets of 2**k values each, so the state is logarithmic in the
    window. Plain lists, so that the whole detector fits into one state value.
    """

    def __init__(self, state: list | None = None):
        self.levels, self.ticks = state if state else ([[]], 0)

    def state(self) -> list:
        return [self.levels, self.ticks]

    def update(self, x: float) -> bool:
        self.ticks += 1
        self.levels[0].append([1, float(x), 0.0])
        k = 0
        while len(self.levels[k]) > ADWIN_BUCKETS:
            a, b = self.levels[k].pop(0), self.levels[k].pop(0)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._merge(a, b))
            k += 1
        return self.ticks % ADWIN_CLOCK == 0 and self._shrink()

    @staticmethod
    def _merge(a: list, b: list) -> list:
        n = a[0] + b[0]
        gap = a[1] / a[0] - b[1] / b[0]
        return [n, a[1] + b[1], a[2] + b[2] + gap * gap * a[0] * b[0] / n]

    def _oldest_first(self) -> list:
        return [b for level in reversed(self.levels) for b in level]

    def _shrink(self) -> bool:
        found = False
        while True:
            buckets = self._oldest_first()
            total = buckets[0]
            for b in buckets[1:]:
                total = self._merge(total, b)
            if total[0] <= ADWIN_GRACE or not self._has_cut(buckets, total):
                return found
            found = True
            top = next(level for level in reversed(self.levels) if level)
            top.pop(0)

    @staticmethod
    def _has_cut(buckets: list, total: list) -> bool:
        variance = total[2] / total[0]
        log = math.log(2.0 * math.log(total[0]) / ADWIN_DELTA)
        n0, s0 = 0, 0.0
        for b in buckets[:-1]:
            n0, s0 = n0 + b[0], s0 + b[1]
            n1, s1 = total[0] - n0, total[1] - s0
            if n0 < ADWIN_MIN_WINDOW or n1 < ADWIN_MIN_WINDOW:
                continue
            inv = 1.0 / (n0 - ADWIN_MIN_WINDOW + 1) + 1.0 / (n1 - ADWIN_MIN_WINDOW + 1)
            if abs(s0 / n0 - s1 / n1) > math.sqrt(2.0 * inv * variance * log) + 2.0 / 3.0 * inv * log:
                return True
        return False


class Monitor:
    """All detectors of one module; ``state`` and ``load`` move it in and out of keyed state."""

    def __init__(self, data: dict | None = None):
        d = data or {}
        self.n = d.get("n", 0)
        self.recent = deque(d.get("recent", []))
        self.recent_errors = sum(self.recent)
        self.base_n, self.base_e = d.get("base", [0, 0])
        self.adwin = Adwin(d.get("adwin"))
        self.ddm = d.get("ddm", [0, 0, None, None])
        self.ph = d.get("ph", [0, 0.0, 0.0, 0.0])
        self.last = d.get("last", {})
        self.drift_at = d.get("drift_at")

    def state(self) -> dict:
        return {"n": self.n, "recent": list(self.recent), "base": [self.base_n, self.base_e], "adwin": self.adwin.state(),
                "ddm": self.ddm, "ph": self.ph, "last": self.last, "drift_at": self.drift_at}

    def _ddm(self, x: int) -> tuple[bool, bool]:
        n, e, p_min, s_min = self.ddm
        n, e = n + 1, e + x
        p = e / n
        s = math.sqrt(p * (1 - p) / n)
        if n >= DDM_MIN and e > 0 and (p_min is None or p + s < p_min + s_min):
            p_min, s_min = p, s
        known = n >= DDM_MIN and p_min is not None
        drift = known and p + s > p_min + DDM_DRIFT * s_min
        warn = known and not drift and p + s > p_min + DDM_WARN * s_min
        self.ddm = [0, 0, None, None] if drift else [n, e, p_min, s_min]
        return drift, warn

    def _ph(self, x: int) -> bool:
        n, total, m, low = self.ph
        n, total = n + 1, total + x
        m += x - total / n - PH_DELTA
        low = min(low, m)
        drift = n >= PH_MIN and m - low > PH_LAMBDA
        self.ph = [0, 0.0, 0.0, 0.0] if drift else [n, total, m, low]
        return drift

    def update(self, x: int) -> dict:
        self.n += 1
        self.recent.append(x)
        self.recent_errors += x
        if len(self.recent) > WINDOW:
            self.recent_errors -= self.recent.popleft()
        if self.base_n < WINDOW:
            self.base_n, self.base_e = self.base_n + 1, self.base_e + x
        ddm, warn = self._ddm(x)
        votes = {"adwin": self.adwin.update(x), "ph": self._ph(x), "ddm": ddm}
        self.last.update({k: self.n for k, v in votes.items() if v})
        active = sum(1 for k in votes if k in self.last and self.n - self.last[k] <= ACTIVE)
        status = "drift" if active >= 2 else "warning" if active == 1 or warn else "stable"
        if status == "drift" and self.drift_at is None:
            self.drift_at = self.n
        now, base = self.recent_errors / len(self.recent), self.base_e / self.base_n
        return {"n": self.n, **votes, "status": status, "drift_detected_at": self.drift_at,
                "error_rate_current": now, "error_rate_baseline": base, "delta": now - base}


SIGNAL = ("module string, ts timestamp, n long, adwin boolean, ph boolean, ddm boolean, status string, "
          "drift_detected_at long, error_rate_current double, error_rate_baseline double, delta double")


def drift_signals(errors: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Streaming drift signals per module, one output row per change of status.

    errors: module, ts, error, and optionally ``reset`` (true on a control row after retraining, which clears the module's
    state) and ``restore`` (on a control row, a state as ``state_snapshot`` gives it, which replaces the module's). State is
    one small value per module. A module's rows of a micro-batch are put in order before they are read, of equal ones
    control rows first; the source's trigger limits bound them. Detection is sequential per key by nature: for more
    parallelism give finer keys, for example module and source.
    """
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if "reset" not in errors.columns:
        errors = errors.withColumn("reset", F.lit(False))
    if "restore" not in errors.columns:
        errors = errors.withColumn("restore", F.lit(None).cast("string"))
    columns = list(dict.fromkeys(["module", "ts", "error", "reset", "restore", *order]))

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data = json.loads(state.get[0]) if state.exists else {}
        monitor, status = Monitor(data.get("monitor")), data.get("status", "stable")
        out = []
        rows = pd.concat(list(chunks))
        control = rows["restore"].isna() & ~rows["reset"].fillna(False).astype(bool)
        for row in rows.assign(control=control).sort_values([*order, "control"], kind="stable").itertuples():
            if isinstance(row.restore, str):
                held = json.loads(row.restore)
                monitor, status = Monitor(held["monitor"]), held["status"]
                continue
            if row.reset:
                monitor, status = Monitor(), "stable"
                continue
            signal = monitor.update(int(row.error))
            if signal["status"] != status:
                status = signal["status"]
                out.append({"module": key[0], "ts": row.ts, **signal})
        if out:
            yield pd.DataFrame(out).astype({"drift_detected_at": "Int64"})
        state.update((json.dumps({"monitor": monitor.state(), "status": status}),))

    return errors.select(*columns).groupBy("module").applyInPandasWithState(
        step, SIGNAL, "data string", "append", GroupStateTimeout.NoTimeout)


def state_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(module, state, n, status, drift_detected_at, window_n, window_errors, baseline_n, baseline_errors): the detectors of a
    ``drift_signals`` stream as its checkpoint holds them, one row a module.

    ``state`` is what a control row's ``restore`` takes, so a stream can go on from a stored snapshot with a new checkpoint.
    """
    kept = spark.read.format("statestore").load(checkpoint)
    kind = ("status string, monitor struct<n: long, recent: array<int>, base: array<long>, drift_at: long>")
    rows = kept.select(F.col("key.module").alias("module"), F.col("value.groupState.data").alias("state")).withColumn("s", F.from_json("state", kind))
    m = F.col("s.monitor")
    return rows.select(
        "module", "state", m["n"].alias("n"), F.col("s.status").alias("status"), m["drift_at"].alias("drift_detected_at"),
        F.size(m["recent"]).cast("long").alias("window_n"), F.aggregate(m["recent"], F.lit(0).cast("long"), lambda a, x: a + x).alias("window_errors"),
        m["base"][0].alias("baseline_n"), m["base"][1].alias("baseline_errors"))


def restore_rows(snapshot: DataFrame, at: Column) -> DataFrame:
    """Control rows (module, ts, error, reset, restore) that set the detectors to a snapshot; ``at`` lies before the rows that follow."""
    return snapshot.select("module", at.alias("ts"), F.lit(0).alias("error"), F.lit(False).alias("reset"), F.col("state").alias("restore"))


def run_signals(errors: DataFrame, order: tuple[str, ...] = ("ts",), checkpoint: str | None = None) -> tuple[DataFrame, str]:
    """(signals, checkpoint): runs ``drift_signals`` over what a bounded stream holds and waits for its end.

    Signals are written to the shared folder by micro-batch, so a batch that runs again writes the same files anew.
    """
    spark = errors.sparkSession
    path, checkpoint = shared_folder(spark, "signals"), checkpoint or shared_folder(spark, "drift")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream = drift_signals(errors, order).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SIGNAL).parquet(path), checkpoint

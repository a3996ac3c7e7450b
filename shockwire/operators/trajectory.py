"""Score paths before events: normalising, typing and matching them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.functions.hdbscan import hdbscan, silhouette
from shockwire.functions.vectors import cosine, distance
from shockwire.sources.shared import cut

#: Points of a path that are known by phase: name -> length of the prefix.
PHASES = {"D-21": 2, "D-14": 3, "D-7": 4, "D-0": 5}


def paths(scores: DataFrame, offsets: tuple[int, ...] = (30, 21, 14, 7, 0)) -> DataFrame:
    """(event_id, days_before, raw_score) to (id, path), the earliest point first; 0 where one is missing."""
    value = lambda k: F.coalesce(F.max(F.when(F.col("days_before") == k, F.col("raw_score"))), F.lit(0.0))
    return scores.groupBy(F.col("event_id").alias("id")).agg(F.array(*map(value, offsets)).alias("path"))


def normalise(path: DataFrame, how: str = "global") -> DataFrame:
    """Each path to 0..1 by its own range (minmax; flat ones to 0), or all by the largest point (global)."""
    if how == "minmax":
        lo, hi = F.array_min("path"), F.array_max("path")
        return path.withColumn("path", F.when(hi > lo, F.transform("path", lambda x: (x - lo) / (hi - lo))).otherwise(F.transform("path", lambda x: x * 0.0)))
    top = F.max(F.array_max("path")).over(Window.partitionBy(F.lit(0)))
    return path.withColumn("_top", top).withColumn("path", F.when(F.col("_top") > 0, F.transform("path", lambda x: x / F.col("_top"))).otherwise(F.col("path"))).drop("_top")


def similarity(a: Column, b: Column, alpha: float = 0.7) -> Column:
    """Alpha x cosine + (1 - alpha) x (1 - distance / sqrt(n), 0 at least); 0 below two points or for a zero path."""
    near = 1 - F.least(distance(a, b) / F.sqrt(F.size(a)), F.lit(1.0))
    zero = lambda v: F.forall(v, lambda x: F.abs(x) <= 1e-8)
    return F.when((F.size(a) < 2) | zero(a) | zero(b), 0.0).otherwise(alpha * cosine(a, b) + (1 - alpha) * near)


def match(path: DataFrame, types: DataFrame, alpha: float = 0.7, own: tuple[str, str] | None = None) -> DataFrame:
    """Each path against the prefixes of every non-noise type (type_id, label, centroid), by similarity to four
    digits; best first, then by type and the longer prefix. Types are a dictionary of a few rows; a path's known part may be
    shorter than a prefix, which is then skipped. own: columns of path and types that have to be equal."""
    phases = F.array(*[F.struct(F.lit(k).alias("phase"), F.lit(n).alias("points")) for k, n in PHASES.items()])
    known = types.where("label >= 0")
    both = path.crossJoin(known.select("type_id", "centroid")) if own is None else path.join(known.select(F.col(own[1]).alias("_own"), "type_id", "centroid"), F.col(own[0]) == F.col("_own"))
    tried = both.withColumn("p", F.explode(phases)).where(F.size("path") >= F.col("p.points"))
    cut = lambda v: F.slice(v, F.lit(1), F.col("p.points"))
    found = tried.select("id", "type_id", "p.phase", "p.points", F.round(similarity(cut(F.col("path")), cut(F.col("centroid")), alpha), 4).alias("similarity"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "type_id", F.desc("points"))))


def top_matches(matches: DataFrame, n: int = 10) -> DataFrame:
    """T4: each path's n best matches, each with the next one's type, phase and similarity (null after the last)."""
    w = Window.partitionBy("id").orderBy("rank")
    after = {f"next_{c}": F.lead(c).over(w) for c in ("type_id", "phase", "similarity")}
    return matches.withColumns(after).where(F.col("rank") <= n).select("id", "rank", "type_id", "phase", "similarity", *after)


def confidence_limits(control_matches: DataFrame) -> DataFrame:
    """Threshold, the 95th percentile of controls' best similarities, and margin, half their deviation."""
    best = control_matches.where("rank = 1")
    four = lambda x: F.round(x + 1e-9, 4)  # a tie goes up, whatever its last bits are
    return best.agg(four(F.percentile("similarity", F.lit(0.95))).alias("threshold"), four(F.stddev_pop("similarity") * 0.5).alias("margin"))


def confidence(matches: DataFrame, limits: DataFrame) -> DataFrame:
    """Unclassifiable below the threshold, uncertain within the margin of the next match, of whatever type and phase,
    else confident."""
    best = top_matches(matches, 1)
    told = F.when(F.col("similarity") < F.col("threshold"), "unclassifiable").when(F.col("similarity") - F.col("next_similarity") < F.col("margin"), "uncertain").otherwise("confident")
    return best.crossJoin(limits).select("id", "type_id", "phase", "similarity", told.alias("confidence"))


def type_table(labelled: DataFrame) -> DataFrame:
    """By label of (id, path, label): members, size, mean and deviation (of the population) at each point."""
    points = labelled.select("label", F.posexplode("path").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    shape = points.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("p"))
    members = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("cluster_size"), F.sort_array(F.collect_list("id")).alias("member_events"))
    out = members.join(shape, "label")
    name = F.when(F.col("label") < 0, "noise").otherwise(F.concat(F.lit("type_"), F.col("label").cast("string")))
    return out.select(name.alias("type_id"), "label", "cluster_size", F.transform("p", lambda s: s["m"]).alias("centroid"), F.transform("p", lambda s: s["s"]).alias("std"), "member_events")


def shape_name(c: Column) -> Column:
    """A centroid in a word, from its range, the means of its first and second half (the middle point is in the second),
    its deviation and its last two steps; the first rule that holds. unknown below three points."""
    n = F.size(c)
    half = F.floor(n / 2).cast("int")
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(v) > 0, F.size(v))
    early, late = mean(F.slice(c, F.lit(1), half)), mean(F.slice(c, half + 1, n - half))
    whole = mean(c)
    deviation = F.sqrt(mean(F.transform(c, lambda x: (x - whole) * (x - whole))))
    last = [F.try_element_at(c, F.lit(-k)) for k in (1, 2, 3)]
    return (
        F.when(n < 3, "unknown").when(F.array_max(c) - F.array_min(c) < 0.1, "flat").when((early < 0.3) & (late > 0.6), "late-surge").when((early > 0.4) & (late > 0.6), "gradual-build")
        .when(deviation < 0.15, "plateau").when((last[0] > last[1]) & (last[1] > last[2]), "accelerating").otherwise("mixed")
    )


#: Paths that one group may hold: a group is clustered in one task, whose memory and time grow with the square of them.
MAX_PATHS = 5_000


def _bounded(rows: int) -> None:
    if rows > MAX_PATHS:
        raise ValueError(f"{rows} paths in one group: clustering in one task is for {MAX_PATHS} at most; cluster by group")


def cluster(path: DataFrame, min_cluster_size: int, group: str = "_all") -> DataFrame:
    """(id, path, label) by HDBSCAN, one group a task. A group is a set of events, a few hundred rows; more than
    MAX_PATHS raise."""
    keyed = path if group in path.columns else path.withColumn(group, F.lit(0))
    kind = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(pdf))
        pdf = pdf.sort_values("id", ignore_index=True)
        pdf["label"] = hdbscan(np.array(pdf["path"].tolist(), dtype=float), min_cluster_size)
        return pdf[[group, "id", "path", "label"]]

    return keyed.select(group, "id", "path").groupBy(group).applyInPandas(run, f"{group} {kind[group]}, id {kind['id']}, path array<double>, label int")


def search_cluster_sizes(path: DataFrame, sizes: range = range(5, 21)) -> DataFrame:
    """Clusters, noise and silhouette (noise counts as a cluster; -1 below two clusters) for each size; sizes run
    side by side."""
    keyed = path.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(pdf))
        pdf = pdf.sort_values("id")
        x, size = np.array(pdf["path"].tolist(), dtype=float), int(pdf["size"].iloc[0])
        labels = hdbscan(x, size)
        n = len(set(labels) - {-1})
        return pd.DataFrame({"size": [size], "n_clusters": [n], "n_noise": [int((labels < 0).sum())], "silhouette": [silhouette(x, labels) if n > 1 else -1.0]})

    return keyed.groupBy("size").applyInPandas(run, "size int, n_clusters int, n_noise int, silhouette double")


def best_cluster_size(tried: DataFrame) -> DataFrame:
    """The row of the largest silhouette, the smallest size of equals."""
    return tried.orderBy(F.desc("silhouette"), "size").limit(1)


def leave_one_out(labelled: DataFrame, min_cluster_size: int, alpha: float = 0.7) -> DataFrame:
    """For each id, the others are clustered anew, and the path is matched with their types, in full and by its first
    three points, each by all prefixes that are short enough. agrees: both find the same type (none: false). Held-out ids are
    tasks of their own; MAX_PATHS of them or more raise."""
    n = labelled.count()
    _bounded(n)
    some = labelled.select("id", "path", "label")
    keyed = some.join(F.broadcast(some.select(F.col("id").alias("held"))), F.col("id") != F.col("held"))  # MAX_PATHS rows at most

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf.sort_values("id", ignore_index=True)
        x = np.array(rest["path"].tolist(), dtype=float)
        labels = hdbscan(x, min_cluster_size)
        kinds = sorted(set(labels.tolist()) - {-1})
        if not kinds:
            return pd.DataFrame()
        return pd.DataFrame({"held": [pdf["held"].iloc[0]] * len(kinds), "type_id": [f"type_{k}" for k in kinds], "label": kinds, "centroid": [x[labels == k].mean(axis=0) for k in kinds]})

    types = keyed.groupBy("held").applyInPandas(run, f"held {dict(labelled.dtypes)['id']}, type_id string, label int, centroid array<double>")
    types = cut(types)  # both matches use it
    best = lambda path: match(path, types, alpha, own=("id", "held")).where("rank = 1")
    full = best(some).select("id", F.col("type_id").alias("full_type"), F.col("similarity").alias("full_similarity"))
    partial = best(some.withColumn("path", F.slice("path", 1, 3))).select("id", F.col("type_id").alias("partial_type"), F.col("phase").alias("partial_phase"), F.col("similarity").alias("partial_similarity"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = some.join(full, "id", "left").join(partial, "id", "left")
    return out.select("id", F.col("label").alias("true_label"), "full_type", zero("full_similarity"), "partial_type", "partial_phase", zero("partial_similarity"), F.coalesce(F.col("full_type") == F.col("partial_type"), F.lit(False)).alias("agrees"))


def best_normalisation(scores: DataFrame, sizes: range = range(5, 21)) -> DataFrame:
    """Minmax and global normalisation with their best cluster size by silhouette, the better first."""
    out = []
    for how, alpha in (("minmax", 0.7), ("global", 0.5)):
        tried = search_cluster_sizes(normalise(paths(scores), how), sizes)
        best = best_cluster_size(tried)
        out.append(best.select(F.lit(how).alias("method"), F.lit(alpha).alias("alpha"), "size", "n_clusters", "n_noise", "silhouette"))
    both = out[0].unionByName(out[1])
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("silhouette"), F.desc("method"))))


def separation(event_matches: DataFrame, control_matches: DataFrame) -> DataFrame:
    """By kind (event, control) the best similarities' number, mean, deviation (of all), largest and 95th percentile, and
    how many reach the controls' 95th percentile."""
    limits = confidence_limits(control_matches)
    best = lambda df, kind: df.where("rank = 1").select(F.lit(kind).alias("kind"), "similarity")
    both = best(event_matches, "event").unionByName(best(control_matches, "control")).crossJoin(limits)  # limits: one row
    above = F.avg(F.when(F.col("similarity") >= F.col("threshold"), 1.0).otherwise(0.0))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean_similarity"), F.stddev_pop("similarity").alias("std_similarity"), F.max("similarity").alias("max_similarity"), F.percentile("similarity", F.lit(0.95)).alias("p95_similarity"), above.alias("share_above"))


def time_split(labelled_dates: DataFrame, cutoff: str, min_cluster_size: int, alpha: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Types learnt from paths (id, path, date) before the cutoff, matched with the others; paths without a date are in
    neither part. Gives a summary (one row) and the best matches (id, type_id, phase, similarity). The split is skipped, with
    a reason and no matches, below twice min_cluster_size early paths and below two clusters."""
    day = F.lit(cutoff).cast("date")
    early, late = labelled_dates.where(F.col("date") < day), labelled_dates.where(F.col("date") >= day)
    labelled = cut(cluster(early.select("id", "path"), min_cluster_size).select("id", "path", "label"))
    sizes = labelled.agg(F.count(F.lit(1)).alias("n_train"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_train_clusters"))
    sizes = sizes.crossJoin(late.agg(F.count(F.lit(1)).alias("n_test")))  # one row each
    reason = F.when(F.col("n_train") < 2 * min_cluster_size, "insufficient_train_data").when(F.col("n_train_clusters") < 2, F.concat(F.lit("only_"), F.col("n_train_clusters").cast("string"), F.lit("_clusters")))
    sizes = sizes.withColumn("reason", reason)
    usable = sizes.where("reason is null").select("n_train")  # one row or none
    matches = match(late.select("id", "path").join(usable, how="cross").drop("n_train"), type_table(labelled), alpha).where("rank = 1").select("id", "type_id", "phase", "similarity")
    found = matches.agg(F.count(F.lit(1)).alias("matched_count"), F.round(F.avg("similarity"), 4).alias("mean_similarity"))
    return sizes.crossJoin(found).select(F.col("reason").isNotNull().alias("skipped"), "reason", "n_train", "n_test", "n_train_clusters", "matched_count", "mean_similarity"), matches

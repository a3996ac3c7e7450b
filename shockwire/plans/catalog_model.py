"""Queries on tagging, the dictionary, validation, trajectories and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.operators import diagnosis, dictionary, scoring, stats, tagging, text, trajectory, validation, windows
from shockwire.plans import catalog_events as base
from shockwire.plans import standins as s
from shockwire.plans.catalog_events import rounded
from shockwire.registry import query
from shockwire.sources.shared import cut


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return s.property_vectors_input(spark, d)


def similar(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return tagging.similarities(v, tagging.property_vectors(v), "vec_id")


DIM = f"""{s.VECTORS}, dims AS (SELECT property_id, i, avg(embedding[i]) AS x FROM vectors, range(1, 65) AS r(i) GROUP BY 1, 2),
pv AS (SELECT property_id, list(x ORDER BY i) AS m FROM dims GROUP BY 1), pn AS (SELECT property_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS vector FROM pv),
sim AS (SELECT vec_id, p.property_id, list_dot_product(v.embedding, p.vector) / sqrt(list_dot_product(v.embedding, v.embedding)) AS similarity FROM vectors v CROSS JOIN pn p)"""


@query("M1_property_vectors", f"WITH {DIM} SELECT property_id, round(vector[i], 8) AS x, i FROM pn, (SELECT unnest(range(1, 65))::INT AS i)")
def _(spark, d):
    v = tagging.property_vectors(vectors(spark, d))
    return v.select("property_id", F.posexplode("vector").alias("i", "x")).select("property_id", F.round("x", 8).alias("x"), (F.col("i") + 1).alias("i"))


@query("J12_similarities", f"WITH {DIM} SELECT vec_id, property_id, round(similarity, 8) AS similarity FROM sim")
def _(spark, d):
    return rounded(similar(spark, d))


@query("M3_map_tags", f"WITH {DIM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, property_id) AS n FROM sim) SELECT vec_id, property_id, round(similarity, 8) AS similarity FROM r WHERE n = 1 AND similarity >= 0.2")
def _(spark, d):
    v = vectors(spark, d)
    return rounded(tagging.map_tags(v, tagging.property_vectors(v), "vec_id", 0.2))


@query("M4_tag_articles", f"WITH {DIM} SELECT vec_id, coalesce(string_agg(CASE WHEN similarity >= 0.15 THEN property_id END, ',' ORDER BY property_id), '') AS properties FROM sim GROUP BY 1")
def _(spark, d):
    v = vectors(spark, d)
    properties = tagging.property_vectors(v)
    return tagging.tag_articles(v, properties, properties.select("property_id", F.lit(0.15).alias("threshold")), "vec_id").select("vec_id", F.array_join("properties", ",").alias("properties"))


GRID = ", ".join(f"({round(0.1 + i * 0.05, 10)}::DOUBLE)" for i in range(9))
CAL = f"""{DIM}, g AS (SELECT * FROM (VALUES {GRID}) AS v(t)), y AS (SELECT vec_id, property_id, 1 AS y FROM vectors),
c AS (SELECT s.property_id, t, CASE WHEN similarity >= t THEN 1 ELSE 0 END AS hit, coalesce(y, 0) AS y FROM sim s LEFT JOIN y USING (vec_id, property_id) CROSS JOIN g),
f AS (SELECT property_id, t, sum(hit * y) AS tp, sum(hit) AS h, sum(y) AS p FROM c GROUP BY 1, 2 UNION ALL SELECT NULL, t, sum(hit * y), sum(hit), sum(y) FROM c GROUP BY t),
b AS (SELECT *, CASE WHEN h + p > 0 THEN 2 * tp / (h + p)::DOUBLE ELSE 0 END AS f1 FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY f1 DESC, t) AS n FROM b)"""


@query("X16_X17_calibrate", f"WITH {CAL} SELECT property_id, CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS threshold, round(f1, 8) AS f1 FROM r WHERE n = 1")
def _(spark, d):
    v = vectors(spark, d)
    return rounded(tagging.calibrate(v, tagging.property_vectors(v), v.select("vec_id", "property_id"), "vec_id", 0.1, 0.5, 0.05))


@query("M2_encode")
def _(spark, d):
    articles = s.articles(spark, d).withColumn("lead", text.lead_sentences(F.col("body")))
    texts = articles.select("article_id", text.article_text().alias("text"))
    return rounded(tagging.encode(texts, tagging.hashing_encoder).select("article_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding")))


@query("A21_cross_validation", "WITH l AS (SELECT o_orderkey, (o_custkey % 12)::INT - 1 AS c, (o_custkey % 5 + o_orderkey % 2)::INT - 1 AS v FROM orders), n AS (SELECT c, v, count(*) AS n FROM l WHERE c >= 0 GROUP BY 1, 2) SELECT c AS cluster, round(coalesce(max(CASE WHEN v >= 0 THEN n END), 0)::DOUBLE / sum(n), 8) AS cross_validation_confidence FROM n GROUP BY 1")
def _(spark, d):
    labels = s.read(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") % 12).cast("int") - 1).alias("cluster"), ((F.col("o_custkey") % 5 + F.col("o_orderkey") % 2).cast("int") - 1).alias("cv_cluster"))
    return rounded(dictionary.cross_validation(labels))


REP = f"""{s.VECTORS}, t AS (SELECT vec_id, right(property_id, 1)::INT - 1 AS cluster, 'tag' || vec_id AS tag, embedding FROM vectors), k AS (SELECT * FROM t WHERE cluster >= 0),
cd AS (SELECT cluster, i, avg(embedding[i]) AS x FROM k, range(1, 65) AS r(i) GROUP BY 1, 2), cc AS (SELECT cluster, list(x ORDER BY i) AS c FROM cd GROUP BY 1),
sm AS (SELECT cluster, tag, list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c))) AS s FROM k JOIN cc USING (cluster)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, tag) AS n FROM sm)"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    tags = vectors(spark, d).select(F.concat(F.lit("tag"), F.col("vec_id").cast("string")).alias("tag"), (F.substring("property_id", -1, 1).cast("int") - 1).alias("cluster"), "embedding", (F.col("vec_id") % 100).alias("article_id"))
    return dictionary.representatives(tags)


@query("M5_T2_D7_representatives", f"WITH {REP} SELECT cluster, string_agg(tag, ',' ORDER BY n) FILTER (n <= 10) AS cluster_keywords, max(tag) FILTER (n = 1) AS representative_tag, (SELECT count(*) FROM k WHERE k.cluster = rk.cluster) AS cluster_size, (SELECT count(DISTINCT vec_id % 100) FROM k WHERE k.cluster = rk.cluster) AS article_count FROM rk GROUP BY 1")
def _(spark, d):
    return clusters(spark, d).withColumn("cluster_keywords", F.array_join("cluster_keywords", ","))


@query("M6_M7_dictionary", f"WITH {REP}, a AS (SELECT cluster, max(tag) FILTER (n = 1) AS tag, (SELECT count(DISTINCT vec_id % 100) FROM k WHERE k.cluster = rk.cluster) AS n_articles FROM rk GROUP BY 1) SELECT 'Property_' || lpad((row_number() OVER (ORDER BY cluster))::VARCHAR, 3, '0') AS property_id, tag AS representative_tag, n_articles AS article_count FROM a WHERE n_articles BETWEEN 10 AND 80")
def _(spark, d):
    found = clusters(spark, d).withColumn("cross_validation_confidence", F.lit(0.5))
    return dictionary.build_dictionary(dictionary.filter_clusters(found, 100)).select("property_id", "representative_tag", "article_count")


@query("X21_stratified_sample")
def _(spark, d):
    rows = s.articles(spark, d).withColumn("label", (F.col("article_id") % 3 == 0).cast("int"))
    return dictionary.stratified_sample(rows.select("article_id", "date", "label"), 200)


@query("A11_confusion", f"WITH {s.SCORED}, p AS (SELECT label, CASE WHEN score >= 18 THEN 1 ELSE 0 END AS p FROM scored), c AS (SELECT count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 0 AND p = 0) AS tn FROM p) SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 4) AS fpr, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c")
def _(spark, d):
    return validation.confusion(s.scored_labels(spark, d).withColumn("predicted", (F.col("score") >= 18).cast("int")))


@query("M13_time_split", f"WITH {s.SCORED} SELECT CASE WHEN date <= DATE '2019-12-31' THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(label)::BIGINT AS events FROM scored GROUP BY 1")
def _(spark, d):
    train, test = validation.time_split(s.scored_labels(spark, d), "2019-12-31")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("events"))


def _metrics(keys: str, rows: str) -> str:
    return f"SELECT {keys}, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn FROM {rows} GROUP BY ALL"


def _ratios(keys: str, rows: str) -> str:
    return f"SELECT {keys}, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 4) AS fpr, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM {rows}"


@query("M14_alert_levels", f"WITH {s.SCORED}, l AS (SELECT label, least(3, floor(score / 10))::INT AS level FROM scored), e AS (SELECT label, k, level >= k AS p FROM l, (VALUES (1), (2), (3)) AS v(k)), m AS ({_metrics('k', 'e')}), r AS ({_ratios('k', 'm')}) SELECT *, row_number() OVER (ORDER BY f1 DESC, k)::INT AS rank FROM r")
def _(spark, d):
    return validation.alert_levels(s.scored_labels(spark, d).withColumn("level", F.least(F.lit(3), F.floor(F.col("score") / 10).cast("int"))))


@query("M15_ensembles", f"WITH {s.SCORED}, e AS (SELECT label, 'and' AS rule, score >= 10 AND date >= DATE '2019-01-01' AS p FROM scored UNION ALL SELECT label, 'or', score >= 10 OR date >= DATE '2019-01-01' FROM scored), m AS ({_metrics('rule', 'e')}) {_ratios('rule', 'm')}")
def _(spark, d):
    return validation.ensembles(s.scored_labels(spark, d), F.col("score") >= 10, F.col("date") >= F.lit("2019-01-01").cast("date"))


ROC = f"{s.SCORED}, b AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY 1), roc AS (SELECT score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, sum(p) OVER w / sum(n) OVER w::DOUBLE AS precision, sum(p) OVER w / sum(p) OVER ()::DOUBLE AS recall, (sum(n) OVER w - sum(p) OVER w) / (sum(n) OVER () - sum(p) OVER ())::DOUBLE AS fpr FROM b WINDOW w AS (ORDER BY score DESC))"


@query("X14_roc", f"WITH {ROC} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(precision, 8) AS precision, round(recall, 8) AS recall, round(fpr, 8) AS fpr FROM roc")
def _(spark, d):
    return rounded(stats.roc(s.scored_labels(spark, d)))


@query("X14_auc", f"WITH {s.SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored), c AS (SELECT sum(label)::DOUBLE AS p, count(*) - sum(label)::DOUBLE AS n, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS r FROM r) SELECT round((r - p * (p + 1) / 2) / (p * n), 8) AS auc FROM c")
def _(spark, d):
    return rounded(stats.auc(s.scored_labels(spark, d)))


@query("X15_best_f1", f"WITH {ROC}, f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f1 FROM roc) SELECT threshold, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def _(spark, d):
    return rounded(stats.best_f1(stats.roc(s.scored_labels(spark, d))))


LEAD = f"{s.EVENTS}, {s.SCORES}, lead_ AS (SELECT date, (SELECT min(first_shock_date) FROM events_ WHERE first_shock_date >= date) AS next_event FROM scores WHERE risk_score >= 60)"


def leads(spark: SparkSession, d: str) -> DataFrame:
    warnings = s.daily_scores(spark, d).where("risk_score >= 60")
    return validation.lead_times(warnings, base.event_table(spark, d).select(F.col("first_shock_date").alias("date")))


@query("J8_lead_times", f"WITH {LEAD} SELECT date, next_event, (next_event - date)::INT AS lead_days FROM lead_")
def _(spark, d):
    return leads(spark, d)


@query("A15_lead_summary", f"WITH {LEAD}, x AS (SELECT next_event - date AS l FROM lead_) SELECT round(avg(l), 8) AS mean_lead, quantile_cont(l, 0.5)::DOUBLE AS median_lead, min(l)::INT AS min_lead, max(l)::INT AS max_lead, count(*) AS n_warnings, count(l) AS n_with_future FROM x")
def _(spark, d):
    return rounded(validation.lead_summary(leads(spark, d)))


OFF = base.PARAMS + """, o AS (SELECT * FROM (VALUES (30), (21), (14), (7), (0)) AS v(back)), g AS (SELECT event_id, back, first_shock_date - back AS ref_date FROM events_, o),
of_ AS (SELECT event_id, back, property_id, sum(cnt) AS freq FROM g, daily JOIN params USING (property_id) WHERE date BETWEEN ref_date - optimal_window AND ref_date - 1 GROUP BY ALL),
os AS (SELECT g.event_id, g.back, round(coalesce(sum(weight * greatest(freq / ctrl_freq_mean - 1, 0)), 0), 4) AS raw_score FROM g LEFT JOIN of_ USING (event_id, back) LEFT JOIN params USING (property_id) GROUP BY ALL)"""


def offsets(spark: SparkSession, d: str) -> DataFrame:
    return scoring.offset_scores(base.daily(spark, d), base.event_table(spark, d), base.params(spark, d), max(s.WINDOWS))


@query("A16_detection_by_lead", f"WITH {OFF} SELECT back::INT AS lead_days, sum(CASE WHEN raw_score >= 1.5 THEN 1 ELSE 0 END)::BIGINT AS detected, count(*) AS n, round(avg(CASE WHEN raw_score >= 1.5 THEN 1 ELSE 0 END), 8) AS rate, round(avg(raw_score), 6) AS mean_score, round(quantile_cont(raw_score, 0.5), 6) AS median_score FROM os GROUP BY 1")
def _(spark, d):
    found = validation.detection_by_lead(offsets(spark, d).select(F.col("days_before").alias("lead_days"), F.col("raw_score").alias("risk_score")), 1.5)
    return found.select("lead_days", "detected", "n", F.round("rate", 8).alias("rate"), F.round("mean_score", 6).alias("mean_score"), F.round("median_score", 6).alias("median_score"))


@query("A18_score_summary", f"WITH {s.SCORED} SELECT label, count(*) AS n, round(avg(score), 8) AS mean_score, quantile_cont(score, 0.5) AS median_score, max(score) AS max_score, sum(CASE WHEN score >= 18.52 THEN 1 ELSE 0 END)::BIGINT AS n_warning FROM scored GROUP BY 1")
def _(spark, d):
    return rounded(validation.score_summary(s.scored_labels(spark, d)))


@query("A18_histogram", f"WITH {s.SCORED} SELECT label, least(floor(score * 40 / 100), 39)::INT AS bin, count(*) AS n FROM scored GROUP BY 1, 2")
def _(spark, d):
    return validation.histogram(s.scored_labels(spark, d))


@query("A12_percentile_rank", f"WITH {s.SCORED} SELECT round(avg(CASE WHEN score <= 20 THEN 100.0::DOUBLE ELSE 0 END), 2) AS overall, round(avg(CASE WHEN score <= 20 THEN 100.0::DOUBLE ELSE 0 END) FILTER (label = 1), 2) AS event, round(avg(CASE WHEN score <= 20 THEN 100.0::DOUBLE ELSE 0 END) FILTER (label = 0), 2) AS control FROM scored")
def _(spark, d):
    return validation.percentile_rank(s.scored_labels(spark, d), 20.0)


@query("M9_weights", "WITH p AS (SELECT p_partkey, greatest(p_partkey / 100000.0::DOUBLE, 1e-300) AS p FROM part) SELECT p_partkey, round(-log10(p) / max(-log10(p)) OVER (), 8) AS weight FROM p")
def _(spark, d):
    return scoring.weights(s.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") / 100000.0).alias("p_adjusted"))).select("p_partkey", F.round("weight", 8).alias("weight"))


PATH = OFF + ", top_ AS (SELECT max(raw_score) AS m FROM os), pt AS (SELECT event_id AS id, list(raw_score ORDER BY back DESC) AS raw, list(raw_score / m ORDER BY back DESC) AS path FROM os, top_ GROUP BY 1)"


def paths(spark: SparkSession, d: str, how: str = "global") -> DataFrame:
    return trajectory.normalise(trajectory.paths(offsets(spark, d)), how)


@query("W13_normalise_global", f"WITH {PATH} SELECT id, round(path[1], 8) AS d30, round(path[2], 8) AS d21, round(path[3], 8) AS d14, round(path[4], 8) AS d7, round(path[5], 8) AS d0 FROM pt")
def _(spark, d):
    return paths(spark, d).select("id", *[F.round(F.col("path")[i], 8).alias(f"d{k}") for i, k in enumerate((30, 21, 14, 7, 0))])


@query("W13_normalise_minmax", f"WITH {PATH}, mm AS (SELECT id, raw, list_min(raw) AS lo, list_max(raw) AS hi FROM pt) SELECT id, CASE WHEN hi > lo THEN round((raw[1] - lo) / (hi - lo), 8) ELSE 0 END AS d30, CASE WHEN hi > lo THEN round((raw[5] - lo) / (hi - lo), 8) ELSE 0 END AS d0 FROM mm")
def _(spark, d):
    return paths(spark, d, "minmax").select("id", F.round(F.col("path")[0], 8).alias("d30"), F.round(F.col("path")[4], 8).alias("d0"))


def with_labels(every: DataFrame) -> DataFrame:
    """Labels as an input: by the number of the event, one of four noise."""
    return every.withColumn("label", (F.col("id") % 4 - 1).cast("int"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return with_labels(paths(spark, d))


TYPES = PATH + """, lab AS (SELECT id, path, (id % 4 - 1)::INT AS label FROM pt), tp_ AS (SELECT label, i, avg(path[i]) AS m, stddev_pop(path[i]) AS s FROM lab, range(1, 6) AS r(i) GROUP BY 1, 2),
ty AS (SELECT label, CASE WHEN label < 0 THEN 'noise' ELSE 'type_' || label END AS type_id, list(m ORDER BY i) AS centroid, list(s ORDER BY i) AS std FROM tp_ GROUP BY 1)"""


@query("A20_type_table", f"WITH {TYPES} SELECT type_id, ty.label, (SELECT count(*) FROM lab WHERE lab.label = ty.label) AS cluster_size, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM lab WHERE lab.label = ty.label) AS members, i::INT AS i, round(centroid[i], 8) AS centroid, round(std[i], 8) AS std FROM ty, range(1, 6) AS r(i)")
def _(spark, d):
    t = trajectory.type_table(labelled(spark, d)).withColumn("i", F.explode(F.array(*map(F.lit, range(1, 6)))))
    return t.select("type_id", "label", "cluster_size", F.array_join(F.col("member_events").cast("array<string>"), ",").alias("members"), "i", F.round(F.element_at("centroid", F.col("i")), 8).alias("centroid"), F.round(F.element_at("std", F.col("i")), 8).alias("std"))


SIM = "CASE WHEN list_max(list_transform({a}, lambda x: abs(x))) <= 1e-8 OR list_max(list_transform({b}, lambda x: abs(x))) <= 1e-8 THEN 0 ELSE 0.7 * list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) + 0.3 * (1 - least(list_distance({a}, {b}) / sqrt(len({a})), 1)) END"
MATCH = TYPES + f", ph AS (SELECT * FROM (VALUES ('D-21', 2), ('D-14', 3), ('D-7', 4), ('D-0', 5)) AS v(phase, points)), pre AS (SELECT id, type_id, phase, points, path[1:points] AS a, centroid[1:points] AS b FROM pt CROSS JOIN ty CROSS JOIN ph WHERE label >= 0), mt AS (SELECT id, type_id, phase, points, round({SIM.format(a='a', b='b')}, 4) AS similarity FROM pre), mr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, type_id, points DESC) AS rank FROM mt), mn AS (SELECT *, lead(type_id) OVER w AS next_type_id, lead(phase) OVER w AS next_phase, lead(similarity) OVER w AS next_similarity FROM mr WINDOW w AS (PARTITION BY id ORDER BY rank))"


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Every path with every type: paths are made once, for the types and for what is matched with them."""
    every = cut(paths(spark, d))
    return trajectory.match(every, trajectory.type_table(with_labels(every)))


@query("J13_M16_M17_match", f"WITH {MATCH} SELECT id, type_id, phase, similarity FROM mt")
def _(spark, d):
    found = matched(spark, d)
    return found.select("id", "type_id", "phase", "similarity")


@query("A13_M18_limits", f"WITH {MATCH}, b AS (SELECT id, max(similarity) AS s FROM mt GROUP BY 1) SELECT round(quantile_cont(s, 0.95) + 1e-9::DOUBLE, 4) AS threshold, round(stddev_pop(s) * 0.5 + 1e-9::DOUBLE, 4) AS margin FROM b")
def _(spark, d):
    found = matched(spark, d)
    return trajectory.confidence_limits(found)


@query("T4_top_matches", f"WITH {MATCH} SELECT id, rank::INT AS rank, type_id, phase, similarity, next_type_id, next_phase, next_similarity FROM mn WHERE rank <= 10")
def _(spark, d):
    return trajectory.top_matches(matched(spark, d))


@query("M18_confidence", f"WITH {MATCH} SELECT id, type_id, phase, similarity, CASE WHEN similarity < 0.9 THEN 'unclassifiable' WHEN similarity - next_similarity < 0.01 THEN 'uncertain' ELSE 'confident' END AS confidence FROM mn WHERE rank = 1")
def _(spark, d):
    found = matched(spark, d)
    return trajectory.confidence(found, spark.createDataFrame([(0.9, 0.01)], "threshold double, margin double"))


@query("X18_hdbscan")
def _(spark, d):
    return trajectory.cluster(paths(spark, d), 5).select("id", "label")


@query("X19_X20_cluster_sizes")
def _(spark, d):
    return rounded(trajectory.search_cluster_sizes(paths(spark, d), range(3, 9)))


@query("M19_leave_one_out")
def _(spark, d):
    found = trajectory.cluster(paths(spark, d), 4).select("id", "path", "label")
    return rounded(trajectory.leave_one_out(found, 4))


@query("M21_shape_names", f"WITH {TYPES}, sh AS (SELECT type_id, centroid AS c, list_avg(centroid[1:2]) AS early, list_avg(centroid[3:5]) AS late, list_stddev_pop(centroid) AS sd FROM ty) SELECT type_id, CASE WHEN list_max(c) - list_min(c) < 0.1 THEN 'flat' WHEN early < 0.3 AND late > 0.6 THEN 'late-surge' WHEN early > 0.4 AND late > 0.6 THEN 'gradual-build' WHEN sd < 0.15 THEN 'plateau' WHEN c[5] > c[4] AND c[4] > c[3] THEN 'accelerating' ELSE 'mixed' END AS shape FROM sh")
def _(spark, d):
    return trajectory.type_table(labelled(spark, d)).select("type_id", trajectory.shape_name(F.col("centroid")).alias("shape"))


PROF = base.PARAMS + """, o AS (SELECT * FROM (VALUES (0), (7), (14), (21)) AS v(back)), g AS (SELECT event_id, back, first_shock_date - back AS ref_date FROM events_, o),
of_ AS (SELECT event_id, back, property_id, sum(cnt) AS freq FROM g, daily JOIN params USING (property_id) WHERE date BETWEEN ref_date - optimal_window AND ref_date - 1 GROUP BY ALL),
prof AS (SELECT g.event_id, g.back, p.property_id, coalesce(freq, 0) / ctrl_freq_mean AS ratio FROM g CROSS JOIN params p LEFT JOIN of_ USING (event_id, back, property_id))"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.profiles(base.daily(spark, d), base.event_table(spark, d), base.params(spark, d), max(s.WINDOWS))


@query("M23_profiles", f"WITH {PROF} SELECT event_id, back::INT AS days_before, property_id, round(ratio, 8) AS ratio FROM prof")
def _(spark, d):
    return rounded(profiles(spark, d))


NEAR = f"{PROF}, cur AS (SELECT property_id, ratio AS now FROM prof WHERE event_id = 1 AND back = 0), nn AS (SELECT event_id, back, round(CASE WHEN sum(ratio * ratio) > 0 THEN sum(ratio * now) / (sqrt(sum(ratio * ratio)) * sqrt(sum(now * now))) ELSE 0 END, 6) AS similarity FROM prof JOIN cur USING (property_id) GROUP BY 1, 2), nr AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, event_id, back) AS rank FROM nn)"


def nearest(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d)
    return diagnosis.nearest(p, p.where("event_id = 1 and days_before = 0"))


@query("J14_T3_nearest_events", f"WITH {NEAR} SELECT event_id, back::INT AS days_before, similarity, rank::INT AS rank FROM nr WHERE rank <= 20")
def _(spark, d):
    return nearest(spark, d)


@query("D6_best_per_event", f"WITH {NEAR}, b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY similarity DESC, back) AS n FROM nr WHERE rank <= 20) SELECT event_id, back::INT AS days_before, similarity FROM b WHERE n = 1")
def _(spark, d):
    return diagnosis.best_per_event(nearest(spark, d)).select("event_id", "days_before", "similarity")

"""Training, search, importance, leaves, clustering and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import cluster, neighbours, split, trees
from panelspark.operators.encode import log_scale
from panelspark.plans import bundle, scoring, training
from panelspark.plans.features import training_features
from panelspark.registry import labelled, panel, query, rounded, table
from panelspark.registry.evaluation import FOLD_TRAIN, FOLD_VALID, GAP, TRAIN, VALID
from panelspark.schema import SENSORS, column_roles
from panelspark.session import materialize, new_path

INDEX = ["serial_number", "model", "dt"]
FEATURES = ["smart_1_normalized", "smart_3_normalized", "smart_7_normalized", "smart_4raw", "smart_5raw", "smart_9raw", "smart_195_normalized"]
SMALL = {"maxIter": 12, "maxDepth": 3}


def rows(spark, sf):
    return labelled(spark, sf).select(*INDEX, "flag", (F.col("tag") > 0).cast("int").alias("tag"), *FEATURES)


def split_rows(spark, sf):
    """Training and validation rows, written once: a fit reads them many times."""
    return materialize(split.gap_time_split(rows(spark, sf), TRAIN, VALID, GAP), "split")


def fitted(spark, sf, **kw):
    df = split_rows(spark, sf)
    return df, trees.train_gbt(df.filter("split = 'train'"), FEATURES, **SMALL, **kw)


def _scores(model, df):
    return trees.with_probability(model.transform(df)).select(*INDEX, "tag", "prob")


@query("train_gbt")
def train_gbt(spark, sf):
    df = split_rows(spark, sf)
    weight = F.when(F.col("tag") == 1, F.lit(trees.balance_weight(df))).otherwise(1.0)
    model = trees.train_gbt(df, FEATURES, weight=weight, split="split", **SMALL)
    return _scores(model, df.filter("split = 'valid'"))


@query("train_gbt_focal")
def train_gbt_focal(spark, sf):
    df = split_rows(spark, sf)
    return _scores(trees.train_gbt(df, FEATURES, split="split", focal=(0.25, 2.0), **SMALL), df.filter("split = 'valid'"))


@query("early_stop_round")
def early_stop_round(spark, sf):
    df, model = fitted(spark, sf)
    losses = trees.loss_by_round(model, df.filter("split = 'valid'"))
    best, _ = trees.early_stop_round(losses)
    table_rows = [(i, float(v), i == best) for i, v in enumerate(losses, start=1)]
    return spark.createDataFrame(table_rows, "round int, loss double, best boolean")


@query("feature_importance")
def feature_importance(spark, sf):
    _, model = fitted(spark, sf)
    return trees.feature_importance(model, FEATURES)


@query("select_topk_features")
def select_topk_features(spark, sf):
    df, model = fitted(spark, sf)
    best = trees.select_topk_features(trees.feature_importance(model, FEATURES), 3)
    return df.select(*INDEX, "tag", "split", *best)


SPACE = {"maxDepth": [2, 3], "stepSize": (0.05, 0.3)}


@query("random_search")
def random_search(spark, sf):
    df = split.store_folds(split.gap_time_split(rows(spark, sf), TRAIN, VALID, GAP).withColumn("fold", F.lit(0)))
    best, _ = trees.cv_search(df, FEATURES, [], SPACE, {"maxIter": 9}, 10, 0.9, 10, halving=3)
    return best


@query("cv_search")
def cv_search(spark, sf):
    folds = split.store_folds(split.time_series_folds(rows(spark, sf), FOLD_TRAIN, FOLD_VALID))
    best, _ = trees.cv_search(folds, FEATURES, [], SPACE, {"maxIter": 9}, 10, 0.9, 10, halving=3)
    return best


@query("leaf_one_hot")
def leaf_one_hot(spark, sf):
    df, model = fitted(spark, sf, leaves=True)
    out, _ = trees.leaf_one_hot(model, df)
    from pyspark.ml.functions import vector_to_array

    hot = vector_to_array("leaf_features")
    return out.select(*INDEX, "split", F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).cast("int").alias("ones"), F.size(hot).alias("width"))


@query("gbt_leaf_lr")
def gbt_leaf_lr(spark, sf):
    df, model = fitted(spark, sf, leaves=True)
    encoder, regression = trees.leaf_regression(model, df.filter("split = 'train'"), maxIter=10)
    return trees.score_leaf_regression(model, encoder, regression, df.filter("split = 'valid'")).select(*INDEX, "tag", "prob")


@query("save_model")
def save_model(spark, sf):
    df, model = fitted(spark, sf)
    path = new_path(spark, "model")
    trees.save_model(model, path)
    return _scores(trees.load_model(path), df.filter("split = 'valid'"))


@query("saved_fit", "SELECT CAST(0 AS BIGINT) AS differing, true AS alerts")
def saved_fit(spark, sf):
    """Alerts of a fit that was saved with its sensors, bins and scales and loaded again: how many differ."""
    features, known = training_features(labelled(spark, sf), window=7)
    features = materialize(features, "features")
    roles = column_roles(features)
    log = [c for c in ("smart_4raw", "smart_5raw") if c in roles.continuous]
    model = trees.train_gbt(log_scale(features, log), roles.continuous, roles.category, **SMALL)
    fit = bundle.Fit(known, model, roles.continuous, roles.category, log)
    path = new_path(spark, "fit")
    fit.save(spark, path)
    span = {"start": "2024-01-20", "end": "2024-01-30", "quantile": 0.9, "per_day": 10}
    before, after = (materialize(f.predict(panel(spark, sf), **span), "alerts") for f in (fit, bundle.Fit.load(spark, path)))
    differing = before.exceptAll(after).unionByName(after.exceptAll(before))
    return differing.agg(F.count(F.lit(1)).alias("differing")).withColumn("alerts", F.lit(not after.isEmpty()))


@query("predict")
def predict(spark, sf):
    """A fitted model's alerts in the layout of the result file."""
    df, model = fitted(spark, sf)
    return scoring.predict_alerts(df.filter("split = 'valid'"), model, quantile=0.9, per_day=10)


@query("train_pipeline")
def train_pipeline(spark, sf):
    """Sampling, split, scaling, fit and evaluation in one job: quality on the validation span."""
    _, quality = training.train(
        rows(spark, sf), TRAIN, VALID, amount=0.5, gap=GAP, quantile=0.9, per_day=10, log=["smart_4raw", "smart_5raw", "smart_9raw"], **SMALL
    )
    return rounded(quality)


CLUSTER = ["smart_1_normalized", "smart_4raw", "smart_195_normalized"]
CENTERS = [[50.0, 2.0, 30.0], [200.0, 4.0, 100.0], [120.0, 3.0, -1.234]]


@query("kmeans_elbow")
def kmeans_elbow(spark, sf):
    df = labelled(spark, sf).select((F.col("tag") > 0).cast("int").alias("tag"), *SENSORS)
    return cluster.kmeans_elbow(materialize(df, "cluster"), SENSORS, range(1, 10))


def _center_sql() -> str:
    dist = [
        "sqrt(" + " + ".join(f"pow(coalesce({c}, -1.234) - ({x})::DOUBLE, 2)" for c, x in zip(CLUSTER, center)) + ")" for center in CENTERS
    ]
    return f"""SELECT serial_number, model, dt, CAST(tag > 0 AS INT) AS tag, CASE WHEN tag = 0 THEN CAST(CASE
       WHEN {dist[0]} <= {dist[1]} AND {dist[0]} <= {dist[2]} THEN 0 WHEN {dist[1]} <= {dist[2]} THEN 1 ELSE 2 END AS INT) END AS cluster_label FROM labelled"""


@query("attach_cluster_label", _center_sql(), ("labelled",))
def attach_cluster_label(spark, sf):
    out = cluster.attach_cluster_label(rows(spark, sf), CLUSTER, CENTERS)
    return out.select(*INDEX, "tag", "cluster_label")


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    df = materialize(rows(spark, sf).select(*INDEX, "tag", *CLUSTER), "cluster")
    centers = cluster.fit_centers(df.filter("tag = 0"), CLUSTER, 3, rounds=5)
    return cluster.attach_cluster_label(df, CLUSTER, centers).select(*INDEX, "tag", "cluster_label")


NEAR = """near AS (SELECT key, neighbour, distance, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM (
    SELECT a.key, b.key AS neighbour, list_distance(a.v, b.v) AS distance FROM points a JOIN points b ON a.key <> b.key) QUALIFY rank <= 5)"""


@query(
    "smote_neighbours",
    f"""WITH points AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {NEAR}
       SELECT key AS vec_id, CAST(rank AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM near""",
)
def smote_neighbours(spark, sf):
    return rounded(neighbours.nearest_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 5))


UNIT = "CAST(CAST('0x' || substr(md5(concat_ws('|', base, copy, {seed})), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query(
    "smote",
    f"""WITH points AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 5), {NEAR},
       w AS (SELECT count(*) FILTER (WHERE label <> 5) - count(*) FILTER (WHERE label = 5) AS wanted FROM embeddings),
       m AS (SELECT key AS base, v, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS size FROM points),
       c AS (SELECT base, v, CAST(unnest(range(CAST(floor((i + 1) * wanted / size) - floor(i * wanted / size) AS BIGINT))) AS BIGINT) AS copy
             FROM m CROSS JOIN w),
       d AS (SELECT base, copy, v, 1 + CAST(floor({UNIT.format(seed=42)} * 5) AS INT) AS pick, {UNIT.format(seed=43)} AS way FROM c)
       SELECT d.base, d.copy, n.neighbour, round(d.v[1] + (p.v[1] - d.v[1]) * way, 6) + 0.0 AS x0,
       round(d.v[64] + (p.v[64] - d.v[64]) * way, 6) + 0.0 AS x63
       FROM d JOIN near n ON n.key = d.base AND n.rank = d.pick JOIN points p ON p.key = n.neighbour""",
)
def smote(spark, sf):
    df = table(spark, sf, "embeddings")
    sizes = df.agg(F.count_if(F.col("label") == 5).alias("few"), F.count_if(F.col("label") != 5).alias("many")).first()
    made = neighbours.smote(df.filter("label = 5"), "vec_id", "embedding", sizes["many"] - sizes["few"])
    return rounded(made.select("base", "copy", "neighbour", F.col("vector")[0].alias("x0"), F.col("vector")[63].alias("x63")))


@query(
    "smote_balance",
    "SELECT CAST(t AS INT) AS tag, (SELECT max(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY tag > 0)) AS n FROM (VALUES (0), (1)) v(t)",
    ("labelled",),
)
def smote_balance(spark, sf):
    df = rows(spark, sf).withColumn("key", F.concat_ws("|", "serial_number", "model", "dt"))
    out = neighbours.smote_balance(df, "key", FEATURES)
    return out.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))

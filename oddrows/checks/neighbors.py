"""Nearest neighbours, exact pair statistics, density models."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import BASE_COLS, BASE_SQL, LOGS_SQL, RAW_BASE_SQL, logs, on_logs, query, rounded, table
from oddrows.operators import features as ft
from oddrows.operators import neighbors as nb
from oddrows.models.density import dbscan, kde_logdensity

DIMS = 64
XS = [f"x{i}" for i in range(DIMS)]


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(XS)])


PAIRS = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS neighbor, a.label, b.label AS nlabel, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id) "


@query("knn_join", PAIRS + "SELECT vec_id, neighbor, CAST(r AS INT) AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS r FROM d) WHERE r <= 10")
def knn_join(spark, sf_dir):
    return rounded(nb.knn_join(vectors(spark, sf_dir), XS, "vec_id", 10))


@query("same_class_ratio", PAIRS + "SELECT round(avg(CAST(label = nlabel AS INT)), 6) AS same_class_ratio FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS r FROM d) WHERE r <= 9")
def same_class_ratio(spark, sf_dir):
    return rounded(nb.same_class_ratio(vectors(spark, sf_dir), XS, "vec_id", "label"))


@query(
    "nearest_neighbor_assign",
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT a.vec_id, b.label, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0) WHERE r = 1",
)
def nearest_neighbor_assign(spark, sf_dir):
    df = vectors(spark, sf_dir)
    out = nb.nearest_neighbor_assign(df.filter("vec_id % 4 = 0"), df.filter("vec_id % 4 <> 0"), XS, "vec_id", "label")
    return rounded(out.select("vec_id", "label", "distance"))


@query(
    "pairwise_distance_stats",
    PAIRS
    + "SELECT 'all' AS scope, count(*) // 2 AS pairs, round(min(distance), 6) AS min, round(max(distance), 6) AS max, round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.5), 6) AS median FROM d UNION ALL SELECT CAST(label AS VARCHAR), count(*) // 2, round(min(distance), 6), round(max(distance), 6), round(avg(distance), 6), NULL FROM d WHERE label = nlabel GROUP BY label",
)
def pairwise_distance_stats(spark, sf_dir):
    return rounded(nb.pairwise_distance_stats(vectors(spark, sf_dir), XS, "vec_id", "label"))


@query(
    "silhouette",
    PAIRS
    + ", s AS (SELECT vec_id, label, nlabel, sum(distance) AS s, count(*) AS n FROM d GROUP BY ALL), ab AS (SELECT vec_id, max(CASE WHEN label = nlabel THEN s / n END) AS a, min(CASE WHEN label <> nlabel THEN s / n END) AS b FROM s GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, 'not separated' AS verdict FROM ab",
)
def silhouette(spark, sf_dir):
    return rounded(nb.silhouette(vectors(spark, sf_dir), XS, "vec_id", "label"))


@query(
    "silhouette_fast",
    PAIRS
    + ", s AS (SELECT vec_id, label, nlabel, sum(distance * distance) AS s, count(*) AS n FROM d GROUP BY ALL), ab AS (SELECT vec_id, max(CASE WHEN label = nlabel THEN s / n END) AS a, min(CASE WHEN label <> nlabel THEN s / n END) AS b FROM s GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, 'not separated' AS verdict FROM ab",
)
def silhouette_fast(spark, sf_dir):
    return rounded(nb.silhouette(vectors(spark, sf_dir), XS, "vec_id", "label", exact=False))


KCOLS = list(BASE_COLS)


@query(
    "kde_logdensity",
    on_logs(
        "SELECT id, log_density FROM base JOIN g USING (" + ", ".join(KCOLS) + ")",
        raw_base=RAW_BASE_SQL,
        base=BASE_SQL,
        pts=f"SELECT {', '.join(KCOLS)}, count(*) AS w FROM base GROUP BY {', '.join(KCOLS)}",
        g=f"SELECT {', '.join('p.' + c for c in KCOLS)}, round(ln(sum(q.w * exp(-2 * ({' + '.join(f'power(p.{c} - q.{c}, 2)' for c in KCOLS)})))) - ln((SELECT count(*) FROM base)) - {len(KCOLS)} * (ln(0.5) + 0.5 * ln(2 * pi())), 6) AS log_density FROM pts p, pts q GROUP BY {', '.join('p.' + c for c in KCOLS)}",
    ),
)
def kde(spark, sf_dir):
    df = ft.base_features(logs(spark, sf_dir)).select("id", *KCOLS)
    return rounded(kde_logdensity(df, KCOLS, "id").select("id", "log_density"))


DB_COLS = ["a", "b"]


def band_points(spark, sf_dir):
    """Users as points: mean amount and mean return value, far more spread than repeated."""
    df = logs(spark, sf_dir).groupBy("userId").agg(F.round(F.avg("amount") / 4, 6).alias("a"), F.round(F.avg("returnValue") / 4, 6).alias("b"))
    return df.withColumnRenamed("userId", "id")


USER_POINTS = "SELECT userId AS id, round(avg(amount) / 4, 6) AS a, round(avg(returnValue) / 4, 6) AS b FROM logs GROUP BY userId"
DBSCAN_SQL = (
    f"WITH RECURSIVE logs AS ({{logs}}), u AS ({USER_POINTS}), "
    "near AS (SELECT p.id, q.id AS other FROM u p JOIN u q ON (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) <= 0.16), "
    "core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5), "
    "links AS (SELECT id, other FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)), "
    "reach AS (SELECT id, id AS root FROM core UNION SELECT l.other, r.root FROM reach r JOIN links l ON l.id = r.id), "
    "comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id), "
    "numbered AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM comp)), "
    "owned AS (SELECT id, root FROM comp UNION ALL SELECT n.id, min(c.root) FROM near n JOIN comp c ON c.id = n.other WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id) "
    "SELECT u.id, coalesce(c, -1) AS cluster FROM u LEFT JOIN owned USING (id) LEFT JOIN numbered USING (root)"
)


@query("dbscan", DBSCAN_SQL.replace("{logs}", LOGS_SQL))
def dbscan_users(spark, sf_dir):
    return dbscan(band_points(spark, sf_dir), DB_COLS, "id", 0.4, 5).select("id", "cluster")


@query("dbscan_base_features")
def dbscan_base(spark, sf_dir):
    df = ft.base_features(logs(spark, sf_dir))
    return dbscan(df, list(BASE_COLS), "id", 0.7, 20).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("evil").alias("evil_n"))

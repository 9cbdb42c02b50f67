"""K-Means in plain SQL: farthest-first start and a fixed number of rounds, written out one after the other.

Rounds after the last change leave everything as it is, so the result is that of a loop which stops there.
"""

from __future__ import annotations

from checks.sql import ORACLES, sql
from citemill import fixed
from citemill.synthetic import PROTOCOL as P

_GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


ROUNDS = 100


def rounds(k: int, n: int = ROUNDS) -> str:
    """CTEs from pts(article_id, x) to clustered(article_id, cluster, distance_to_centroid)."""
    gap = _GAP.format(a="p.x", b="c.x")
    out = [f"f1 AS MATERIALIZED (SELECT 0 AS k, x FROM pts ORDER BY md5('{fixed.SEED}|' || article_id), article_id LIMIT 1)"]
    for i in range(1, k):
        far = f"SELECT any_value(p.x) AS x FROM pts p, f{i} c GROUP BY p.article_id ORDER BY min({gap}) DESC, p.article_id LIMIT 1"
        out.append(f"f{i + 1} AS MATERIALIZED (SELECT * FROM f{i} UNION ALL SELECT {i}, x FROM ({far}))")
    centers = f"f{k}"
    for i in range(n + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT p.article_id, any_value(p.x) AS x, list(k ORDER BY {gap}, k)[1] AS k, min({gap}) AS d FROM pts p, {centers} c GROUP BY p.article_id)")
        means = f"SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, avg(v) AS m FROM (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k"
        out.append(f"c{i} AS MATERIALIZED ({means} UNION ALL SELECT k, x FROM {centers} WHERE k NOT IN (SELECT k FROM a{i}))")
        centers = f"c{i}"
    return ", ".join(out) + f", clustered AS MATERIALIZED (SELECT article_id, k::INT AS cluster, sqrt(d) AS distance_to_centroid FROM a{n})"


_POINTS = """pts AS MATERIALIZED (SELECT a.article_id, list((coalesce(c.value, 0) - f.mean) / f.deviation ORDER BY f.feature) AS x
 FROM art a CROSS JOIN fstats f LEFT JOIN chosen_features c ON c.article_id = a.article_id AND c.feature = f.feature GROUP BY a.article_id)"""
_WEIGHED = """placed AS MATERIALIZED (SELECT a.article_id, title, year, doi, article_kind, word_count >= 50 AS text_extractable, cluster, round(distance_to_centroid, 5) AS distance_to_centroid,
 distance_to_centroid AS d, coalesce(w, 0) AS n_relations_weighted FROM art a JOIN clustered USING (article_id) LEFT JOIN (SELECT article_id, sum(w) AS w FROM weighted GROUP BY article_id) USING (article_id))"""


def _job(body: str) -> str:
    """The body over the clusters of the review job."""
    return sql("", "fstats", "chosen_features", "weighted", "art").rstrip() + f",\n{_POINTS}, {rounds(P.kmeans_k)}, {_WEIGHED}\n{body}"


ORACLES.update({
    "kmeans_articles": _job("SELECT * EXCLUDE (d) FROM placed"),
    "cluster_profiles": _job("""SELECT cluster, n_articles, coalesce(string_agg(feature || '=' || printf('%.2f', mean), ' | ' ORDER BY rank), '') AS top_features FROM (
 SELECT s.cluster, n_articles, feature, mean, row_number() OVER (PARTITION BY s.cluster ORDER BY mean DESC, feature) AS rank FROM (SELECT cluster, count(*) AS n_articles FROM clustered GROUP BY cluster) s
 LEFT JOIN (SELECT cluster, feature, round(sum(value) / any_value(n), 9) AS mean FROM chosen_features JOIN clustered USING (article_id) JOIN (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster) USING (cluster) GROUP BY cluster, feature) m
 ON m.cluster = s.cluster AND mean > 0) WHERE rank <= 8 GROUP BY cluster, n_articles"""),
    "cluster_map_labels": _job("""SELECT article_id, cluster FROM (SELECT *, row_number() OVER (ORDER BY n_relations_weighted DESC, article_id) AS r1, row_number() OVER (ORDER BY d DESC, article_id) AS r2,
 row_number() OVER (PARTITION BY cluster ORDER BY n_relations_weighted DESC, article_id) AS r3, row_number() OVER (PARTITION BY cluster ORDER BY d DESC, article_id) AS r4 FROM placed) WHERE r1 <= 12 OR r2 <= 8 OR r3 = 1 OR r4 = 1"""),
    "kmeans_centroids": _job("SELECT k::INT AS cluster, n_articles, " + ", ".join(f"max(feature) FILTER (rank = {i}) AS feature_{i}, round(max(z) FILTER (rank = {i}), 5) AS zscore_{i}" for i in range(1, 21)) + f"""
 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY z DESC, feature) AS rank FROM (SELECT k, unnest((SELECT list(feature ORDER BY feature) FROM fstats)) AS feature, unnest(list_transform(x, lambda v: round(v, 9))) AS z FROM c{ROUNDS}))
 JOIN (SELECT cluster, count(*) AS n_articles FROM clustered GROUP BY cluster) s ON s.cluster = k WHERE rank <= 20 GROUP BY k, n_articles"""),
    "kmeans_vectors": "WITH pts AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS article_id, embedding::DOUBLE[] AS x FROM embeddings), " + rounds(4)
    + " SELECT cluster, count(*) AS members FROM clustered GROUP BY cluster",
})

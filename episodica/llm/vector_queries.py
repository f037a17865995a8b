"""Queries over captures and vectors with their SQL: archives and their index, product codes, centroid clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exponion, product_codes, warc
from .common import remove, shared_path

#: The pages have no time of capture: page n counts as captured n seconds (at most 10^9) after the start of 2024.
FIRST_CAPTURE = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the merged index; the archives go once that is read."""
    pages, path = table(spark, sf_dir, "pages"), shared_path(spark, "archives")
    kind = dict(pages.dtypes)["page_id"]
    captured = F.timestamp_seconds(FIRST_CAPTURE + F.coalesce(F.pmod(F.col("page_id"), F.lit(1_000_000_000)), F.lit(0)))
    warc.write_archives(pages, path, "page_id", "url", "html", captured)
    index = warc.read_index(spark, path)
    remove(spark, path)
    return index.select(F.col("capture_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector under codebooks of 4 parts and 256 entries."""
    vectors = table(spark, sf_dir, "embeddings")
    found = product_codes.compress(vectors, "vec_id", "embedding", "label")
    if found is None:
        return vectors.where("false").selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    out = product_codes.with_label_errors(found.rows)
    return out.select(F.col("id").alias("vec_id"), product_codes.hexadecimal("codes").alias("code"), "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components after 10 rounds over 8 centroids."""
    vectors = table(spark, sf_dir, "embeddings")
    found = exponion.cluster(vectors, "vec_id", "embedding")
    if found is None:
        return vectors.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    return exponion.members(found).withColumnRenamed("id", "vec_id")


_WARC_SQL = """WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT r, page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s FROM p),
f AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS f FROM d WINDOW w AS (PARTITION BY s ORDER BY page_id NULLS LAST, r))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + i // 4 * 5 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN f END AS refers_to FROM f"""

#: Kept vectors with integer components, and the squared distance of two lists of them.
_VECTORS_SQL = "SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARE = "CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT)"


def _lloyd_sql(rounds: int, entries: int) -> str:
    """CTEs a0, b1, a1, ...: assignments ``a`` (nearest entry k of part q, squared distance d) and books ``b`` over p (r, q, x) and b0 (q, k, c)."""
    out = []
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, q, m % {entries} AS k, m // {entries} AS d FROM (SELECT r, q, min({_SQUARE} * {entries} + k) AS m FROM p JOIN b{i} USING (q) GROUP BY r, q))")
        if i < rounds:
            out.append(f"""b{i + 1} AS MATERIALIZED (SELECT q, k, coalesce(n, c) AS c FROM b{i} LEFT JOIN (SELECT q, k, list((s - ((s % n) + n) % n) / n ORDER BY j) AS n FROM (SELECT q, k, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
FROM (SELECT q, k, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{i} JOIN p USING (r, q)) GROUP BY q, k, j) GROUP BY q, k) USING (q, k))""")
    return ",\n".join(out)


_CODES_SQL = f"""WITH v AS MATERIALIZED ({_VECTORS_SQL}), p AS MATERIALIZED (SELECT r, q, e[16 * q + 1 : 16 * q + 16] AS x FROM v, (SELECT unnest(range(4)) AS q)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, e) - 1 AS k FROM v), b0 AS MATERIALIZED (SELECT q, k, x AS c FROM p JOIN f USING (r) WHERE k < 256), {_lloyd_sql(4, 256)},
h AS (SELECT sha256(string_agg(CAST(c AS BIGINT), ',' ORDER BY q, k, j)) AS codebooks_sha256 FROM (SELECT q, k, unnest(c) AS c, generate_subscripts(c, 1) AS j FROM b4)),
o AS (SELECT r, string_agg(format('{{:02x}}', k), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"""

_CLUSTERS_SQL = f"""WITH v AS MATERIALIZED ({_VECTORS_SQL} AND len(embedding) = 64), p AS MATERIALIZED (SELECT r, 0 AS q, e AS x FROM v),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS k FROM v), b0 AS MATERIALIZED (SELECT q, k, x AS c FROM p JOIN f USING (r) WHERE k < 8), {_lloyd_sql(10, 8)},
h AS (SELECT k, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM b10)
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM v JOIN a10 USING (r) JOIN h USING (k)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op11_warc, op12_product_codes, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op11_warc": _WARC_SQL, "op12_product_codes": _CODES_SQL, "op13_centroid_clusters": _CLUSTERS_SQL}

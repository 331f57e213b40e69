"""Centroid clustering of integer vectors by JVM expressions (operator 11).

The distances of a row to all centroids are one expression over a literal array of centroids (zip_with and aggregate), array_min over structs of distance
and number chooses the cluster, and the next centroids are sums of columns that combine before the shuffle. The driver holds the k centroids, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.topk import quantised
from tidemark.session import discard, staged

#: Components must be smaller than this in size, so that squared distances of up to 256 components fit in 64 bits.
BOUND = 1 << 26


def integers(vectors: DataFrame, dims: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, values of the vectors with exactly `dims` components, none null or not finite: floor(scale * x)."""
    rows = quantised(vectors, scale, id_col, vec_col).where(F.col("n") == dims)
    beyond = F.exists("values", lambda v: F.abs(v) >= BOUND)
    checked = F.when(beyond, F.raise_error(F.lit(f"a component is {BOUND} / {scale} or larger")).cast("array<bigint>")).otherwise(F.col("values"))
    return rows.select("vec_id", checked.alias("values"))


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The values of the k rows with the smallest sha256 of salt and vec_id; rows without an id start no centroid, rows of one id come in the order of their values."""
    named = rows.where("vec_id IS NOT NULL").select("values", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"))
    return [list(r["values"]) for r in named.orderBy("hash", "values").limit(k).collect()]


def literal(numbers: list[int]) -> str:
    """A literal array<bigint> in SQL: one expression for the session to parse in place of a call for each number."""
    return "array(" + ", ".join(f"{x}L" for x in numbers) + ")"


def nearest(values: str, centres: list[list[int]]) -> Column:
    """struct(distance, cluster): the least squared distance to the literal centroids, of equal ones the smaller number.

    |v - c|^2 = |v|^2 + (|c|^2 - 2 v c): what depends on the centroid alone is a literal, and a component costs one product and one sum.
    """
    table = F.expr("array(" + ", ".join(f"named_struct('cluster', {c}, 'square', {sum(x * x for x in centre)}L, 'twice', {literal([2 * x for x in centre])})" for c, centre in enumerate(centres)) + ")")
    zero = F.lit(0).cast("bigint")
    add = lambda s, x: s + x
    dot = lambda c: F.aggregate(F.zip_with(F.col(values), c["twice"], lambda x, y: x * y), zero, add)
    best = F.array_min(F.transform(table, lambda c: F.struct((c["square"] - dot(c)).alias("rest"), c["cluster"].alias("cluster"))))
    own = F.aggregate(F.transform(values, lambda x: x * x), zero, add)
    return F.struct((own + best["rest"]).alias("distance"), best["cluster"].alias("cluster"))


def moved(rows: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Each centroid becomes the floor of its rows' mean, exactly; one without rows stays. k rows of sums reach the driver."""
    dims = len(centres[0])
    sums = [F.sum(F.col("values")[i]).alias(f"s{i}") for i in range(dims)]
    found = rows.select("values", nearest("values", centres)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    now = list(centres)
    for r in found:
        if r["n"] * BOUND >= 1 << 63:
            raise OverflowError("a sum of components may be beyond 64 bits")
        now[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return now


def fitted(rows: DataFrame, k: int, rounds: int, salt: str) -> list[list[int]]:
    """The centroids after `rounds` rounds over all rows (vec_id, values); fewer than k where fewer rows have an id."""
    centres = seeds(rows, k, salt)
    for _ in range(rounds if centres else 0):
        centres = moved(rows, centres)
    return centres


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector of `dims` finite components.

    Other vectors (null, of another length, with null or non-finite components) take no part; other columns are left out. Repeated rows count each. Vectors
    with a null id are moved and assigned like others but start no centroid; without any id there is no centroid and no row. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = staged(integers(vectors, dims, scale, id_col, vec_col), "vectors")
    centres = fitted(rows, k, rounds, salt)
    kind = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centres:
        return spark.createDataFrame([], kind)
    best = nearest("values", centres)
    placed = staged(rows.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance"), "clusters")
    discard(rows)
    own = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    if sum(own.values()) >= 1 << 63:
        raise OverflowError("the inertia is beyond 64 bits")
    all_ = F.lit(sum(own.values())).cast("bigint")
    text = F.sha2(F.element_at(F.array(*(F.lit(",".join(map(str, c))) for c in centres)), F.col("cluster") + 1), 256)
    inertia = F.element_at(F.expr(literal([own.get(c, 0) for c in range(len(centres))])), F.col("cluster") + 1)
    return placed.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), all_.alias("inertia"), text.alias("centroid_sha256"))


def oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """DuckDB SQL of `clustered`: a table of centroids for each round."""
    near = "SELECT vec_id, row, e, arg_min(number, (d, number)) AS cluster, min(d) AS distance FROM (SELECT v.*, c.number, CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d FROM v CROSS JOIN {c} c) GROUP BY vec_id, row, e"
    steps = [f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS number, e FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near.format(dims=dims, c=f"c{r}")}),
m{r} AS (SELECT cluster, i, CAST(floor_div AS BIGINT) AS x FROM (SELECT cluster, i, (sum(e[i]) - ((sum(e[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM a{r} CROSS JOIN (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY cluster, i)),
c{r + 1} AS MATERIALIZED (SELECT number, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS e FROM m{r} GROUP BY cluster) n ON n.cluster = c.number)""")
    last = near.format(dims=dims, c=f"c{rounds}")
    return ",\n".join(steps) + f""",
z AS MATERIALIZED ({last})
SELECT z.vec_id, CAST(z.cluster AS INTEGER) AS cluster, z.distance, CAST(sum(z.distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(z.distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c ON c.number = z.cluster"""

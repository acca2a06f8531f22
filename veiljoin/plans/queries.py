"""One query an operator over the test tables, and SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import randomness as rnd
from ..operators import bandwidth, cells, features, join, models, prep, regression, response, selection, sketch, wide
from ..sources.tables import read_table
from ..streaming.membership import add_noise, stream_member_sketch
from . import experiments as ex
from . import sql as q
from . import sweep

Query = Callable[[SparkSession, str], DataFrame]
#: ``WIDTH`` is the length of the test table's vectors, which SQL with literal matrices has to know.
SEED, DIM, FLAGS, WIDTH = q.SEED, 5, 6, 64
#: Likelihoods of the six customer flags in the queries that are given a distribution.
P = [0.3, 0.25, 0.2, 0.1, 0.1, 0.05]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: object, name: str) -> object:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# ---------------------------------------------------------------- tables the queries share


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "n_chars")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "labels").select("doc_id", "quality")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))


def returned(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_extendedprice") / 1000).alias("y"))


ORDERS = "SELECT o_orderkey, o_totalprice / 1000 AS x FROM orders"
RETURNED = "SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) / 1000 AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The two classes 4 and 9 as -1 and 1, with all cells as doubles."""
    df = read_table(spark, d, "embeddings").filter(F.col("label").isin(4, 9))
    x = F.transform("embedding", lambda v: v.cast("double"))
    return df.select(F.col("vec_id").alias("id"), F.when(F.col("label") == 9, 1).otherwise(-1).alias("label"), x.alias("x"))


def width(df: DataFrame) -> int:
    """The number of cells of the vectors ``x``; 0 without rows."""
    return df.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("n")).first().n


VECTORS = "SELECT vec_id AS id, CASE WHEN label = 9 THEN 1 ELSE -1 END AS label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE label IN (4, 9)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, 1.0).otherwise(-1.0).alias("label"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Signs of what a customer's orders hold."""
    o = read_table(spark, d, "orders")
    has = [F.col("o_orderstatus") == s for s in "FOP"] + [F.substring("o_orderpriority", 1, 1) == s for s in "125"]
    yes = lambda c: F.when(F.max(c.cast("int")) == 1, 1.0).otherwise(-1.0)
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.array(*[yes(c) for c in has]).alias("f"))


CUSTOMERS = "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 1e0 ELSE -1e0 END AS label FROM customer"
FLAG_LIST = ", ".join(
    f"CASE WHEN bool_or({c}) THEN 1e0 ELSE -1e0 END"
    for c in [*[f"o_orderstatus = '{s}'" for s in "FOP"], *[f"substr(o_orderpriority, 1, 1) = '{s}'" for s in "125"]]
)
FLAG_ROWS = f"SELECT o_custkey AS id, [{FLAG_LIST}] AS f FROM orders GROUP BY 1"

# ---------------------------------------------------------------- sets, joins, cleaning


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_universe(spark, d):
    return prep.universe(docs(spark, d), labels(spark, d), id="doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_by_index(spark, d):
    return docs(spark, d).join(labels(spark, d), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def inner_control(spark, d):
    return docs(spark, d).join(labels(spark, d), "doc_id")


@query("SELECT doc_id, n_chars, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_control(spark, d):
    return docs(spark, d).join(labels(spark, d), "doc_id", "left").na.fill(0, ["quality"])


@query("SELECT vec_id, CASE label WHEN 4 THEN -1 ELSE 1 END AS label FROM embeddings WHERE label IN (4, 9)")
def class_filter_remap(spark, d):
    return prep.keep_classes(read_table(spark, d, "embeddings").select("vec_id", "label"), "label", {4: -1, 9: 1})


@query("SELECT vec_id, CASE WHEN label = 1 THEN 1 ELSE -1 END AS label FROM embeddings")
def class_collapse(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", prep.collapse_classes(F.col("label"), 1).alias("label"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, d):
    return read_table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, round(o_totalprice / 1000 - (SELECT avg(o_totalprice / 1000) FROM orders), 6) AS x FROM orders")
def center_columns(spark, d):
    return prep.centre(orders(spark, d), ["x"]).select("o_orderkey", r6("x", "x"))


@query(
    f"WITH o AS ({ORDERS}), t AS (SELECT *, {q.u('o_orderkey', 'split')} < 0.8e0 AS train FROM o) "
    "SELECT o_orderkey, train, round(x - (SELECT avg(x) FROM t WHERE train), 6) AS x FROM t"
)
def center_train_test(spark, d):
    df = orders(spark, d).withColumn("train", prep.hash_split(orders(spark, d), "o_orderkey", 0.8, SEED))
    return prep.centre(df, ["x"], df.filter("train")).select("o_orderkey", "train", r6("x", "x"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{p}')::INTEGER AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + " FROM orders")
def one_hot(spark, d):
    return prep.one_hot(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", PRIORITIES)


@query(
    f"WITH e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {q.u('vec_id', 'sample')}, vec_id) AS r FROM embeddings WHERE label IN (4, 9)) "
    "SELECT vec_id, label FROM e WHERE label = 4 OR r <= (SELECT floor(count(*) / 4) FROM e WHERE label = 9)"
)
def stratified_keep(spark, d):
    df = read_table(spark, d, "embeddings").select("vec_id", "label").filter(F.col("label").isin(4, 9))
    return prep.biased_subsample(df, "vec_id", "label", 4, SEED)


@query(
    f"WITH l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {q.u('doc_id', 'sample')}, doc_id) AS r FROM labels) "
    "SELECT doc_id, quality FROM l WHERE r <= round((SELECT count(*) FROM labels) * 0.25e0)"
)
def uniform_subsample(spark, d):
    return prep.subsample(labels(spark, d), "doc_id", 0.25, SEED)


@query(
    f"WITH l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {q.u('doc_id', 'sample')}, doc_id) AS r FROM labels) "
    "SELECT doc_id, quality FROM l WHERE r <= round((SELECT count(*) FROM documents) * 0.2e0)"
)
def subsample_of_known(spark, d):
    return prep.subsample(labels(spark, d), "doc_id", 0.2, SEED, of=docs(spark, d))


@query(
    f"WITH e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {q.u('vec_id', 'sample')}, vec_id) AS r FROM embeddings WHERE label IN (4, 9)) "
    "SELECT vec_id, label FROM e WHERE label = 4 OR r <= (SELECT floor(count(*) / 5) FROM e)"
)
def stratified_keep_of_all(spark, d):
    df = read_table(spark, d, "embeddings").select("vec_id", "label").filter(F.col("label").isin(4, 9))
    return prep.biased_subsample(df, "vec_id", "label", 4, SEED, divisor=5, of="all")


STATUSES = ["F", "O", "P"]


@query(
    "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INTEGER AS \"o_orderstatus_{v}\"" for v in STATUSES)
    + ", " + ", ".join(f"(o_orderpriority = '{p}')::INTEGER AS \"o_orderpriority_{p}\"" for p in PRIORITIES)
    + ", (o_totalprice <= 1000)::INTEGER AS big_false, (o_totalprice > 1000)::INTEGER AS big_true FROM orders"
)
def one_hot_by_type(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 1000).alias("big"))
    out = prep.one_hot_types(rows)
    return out.select("o_orderkey", *[F.col(f"`{c}`") if c in out.columns else F.lit(0).alias(c) for c in (*[f"o_orderstatus_{v}" for v in STATUSES], *[f"o_orderpriority_{p}" for p in PRIORITIES], "big_false", "big_true")])


@query(f"SELECT doc_id, {q.u('doc_id', 'split')} < 0.8e0 AS train FROM labels")
def hash_split(spark, d):
    df = labels(spark, d)
    return df.select("doc_id", prep.hash_split(df, "doc_id", 0.8, SEED).alias("train"))


@query(
    "SELECT vec_id, [(v / 255)::FLOAT FOR v IN embedding] AS cells FROM embeddings"
)
def flatten_scale(spark, d):
    x = features.flatten_scale(F.array("embedding"))
    return read_table(spark, d, "embeddings").select("vec_id", x.alias("cells"))


@query("SELECT id, [least(greatest(v * 2, -sqrt(2e0)), sqrt(2e0)) FOR v IN x] AS x FROM (" + VECTORS + ")")
def clip_cells(spark, d):
    return vectors(spark, d).select("id", features.clip(F.transform("x", lambda v: v * 2)).alias("x"))


# ---------------------------------------------------------------- draws, sketches


@query(f"SELECT doc_id, {q.sign('doc_id', 'memb')} AS s FROM labels")
def sign_hash(spark, d):
    return labels(spark, d).select("doc_id", rnd.sign(F.col("doc_id"), "memb", SEED).alias("s"))


@query(f"SELECT doc_id, {q.bucket('doc_id', 'memb', 64)} AS b FROM labels")
def bucket_hash(spark, d):
    return labels(spark, d).select("doc_id", rnd.bucket(F.col("doc_id"), "memb", SEED, 64).alias("b"))


@query(f"SELECT doc_id, {q.geometric('doc_id', 'z', 1.0)} AS z FROM labels")
def noise_geometric(spark, d):
    return labels(spark, d).select("doc_id", rnd.geometric(F.col("doc_id"), "z", SEED, 1.0).alias("z"))


@query(f"SELECT doc_id, round({q.laplace('doc_id', 'z', 2.0)}, 6) AS z FROM labels")
def noise_laplace(spark, d):
    return labels(spark, d).select("doc_id", r6(rnd.laplace(F.col("doc_id"), "z", SEED, 2.0), "z"))


@query(f"SELECT doc_id, round({q.gaussian('doc_id', 'z')}, 6) AS z FROM labels")
def noise_gaussian(spark, d):
    return labels(spark, d).select("doc_id", r6(rnd.gaussian(F.col("doc_id"), "z", SEED), "z"))


@query(f"SELECT d.doc_id, {q.own_membership('d.doc_id', 'l.doc_id IS NOT NULL', 1.0)} AS membership FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def member_sketch(spark, d):
    return join.join_values(docs(spark, d), labels(spark, d), "doc_id", [], eps_memb=1.0, eps_val=1.0, sens=1.0, seed=SEED, drop=False).select("doc_id", "membership")


MEMBER64 = (
    f"SELECT b.bucket, coalesce(s, 0) + {q.geometric('b.bucket', 'memb', 1.0)} AS value FROM (SELECT range AS bucket FROM range(64)) b "
    f"LEFT JOIN (SELECT {q.bucket('doc_id', 'memb', 64)} AS bucket, sum({q.sign('doc_id', 'memb')}) AS s FROM labels GROUP BY 1) k USING (bucket)"
)


@query(MEMBER64)
def member_sketch_buckets(spark, d):
    return sketch.member_sketch(labels(spark, d), "doc_id", 1.0, 64, SEED)


@query(f"SELECT doc_id, {q.sign('doc_id', 'memb')} * value AS membership FROM documents JOIN ({MEMBER64}) ON {q.bucket('doc_id', 'memb', 64)} = bucket")
def member_decode_buckets(spark, d):
    s = sketch.member_sketch(labels(spark, d), "doc_id", 1.0, 64, SEED)
    return sketch.decode(docs(spark, d).select("doc_id"), "doc_id", s, "memb", 64, SEED, "membership")


@query(f"SELECT o_orderkey, round(coalesce(y, 0) + {q.sign('o_orderkey', 'val.y')} * {q.laplace('o_orderkey', 'val.y', 100.0)}, 6) AS y FROM orders LEFT JOIN ({RETURNED}) USING (o_orderkey)")
def value_sketch(spark, d):
    df = orders(spark, d).join(returned(spark, d), "o_orderkey", "left")
    return df.select("o_orderkey", r6(sketch.own_value(F.col("o_orderkey"), F.col("y"), "y", 1.0, 100.0, SEED), "y"))


@query(
    f"SELECT b.bucket, round(coalesce(s, 0) + {q.laplace('b.bucket', 'val.y', 100.0)}, 4) AS value FROM (SELECT range AS bucket FROM range(256)) b "
    f"LEFT JOIN (SELECT {q.bucket('o_orderkey', 'val.y', 256)} AS bucket, sum({q.sign('o_orderkey', 'val.y')} * y) AS s FROM ({RETURNED}) GROUP BY 1) k USING (bucket)"
)
def value_sketch_buckets(spark, d):
    out = sketch.value_sketch(returned(spark, d), "o_orderkey", "y", 1.0, 100.0, 256, SEED)
    return out.select("bucket", F.round("value", 4).alias("value"))


# ---------------------------------------------------------------- private joins

G1 = (
    f"SELECT o_orderkey, x, {q.own_membership('o_orderkey', 'y IS NOT NULL', 1.0)} AS membership, "
    f"coalesce(y, 0) + {q.sign('o_orderkey', 'val.y')} * {q.laplace('o_orderkey', 'val.y', 100.0)} AS y FROM ({ORDERS}) LEFT JOIN ({RETURNED}) USING (o_orderkey)"
)


def g1(spark, d):
    return join.join_values(orders(spark, d), returned(spark, d), "o_orderkey", ["y"], eps_memb=1.0, eps_val=1.0, sens=100.0, seed=SEED)


@query(f"SELECT o_orderkey, x, membership, round(y, 6) AS y FROM ({G1}) WHERE membership >= 1")
def join_g1(spark, d):
    return g1(spark, d).select("o_orderkey", "x", "membership", r6("y", "y"))


@query(f"SELECT o_orderkey, membership FROM ({G1}) WHERE membership >= 1")
def join_g1_membership_only(spark, d):
    return join.join_values(orders(spark, d), returned(spark, d), "o_orderkey", [], eps_memb=1.0, eps_val=1.0, sens=1.0, seed=SEED).select("o_orderkey", "membership")


def flip_list(flips: list[float], tag: str = "rr") -> str:
    return "[" + ", ".join(f"CASE WHEN {q.u('id', tag, i)} < {p!r}e0 THEN -1e0 ELSE 1e0 END" for i, p in enumerate(flips)) + "]"


TOP3 = selection.top_columns(P, 3)
IND = flip_list([response.flip_probability(0.75 * 2 / 3)] * FLAGS)
IND_UNIF = flip_list([response.flip_probability(2 / 3)] * FLAGS)
WEIGHTED = flip_list([response.flip_probability(1.5 * P[i] / sum(P[j] for j in TOP3) if i in TOP3 else 0.0) for i in range(FLAGS)])
STAY = (math.exp(1.5) - 1) / (math.exp(1.5) + 2.0**3 - 1)
DEP = f"(CASE WHEN {q.u('id', 'rr.row')} < {STAY!r}e0 THEN [{', '.join(['1e0'] * FLAGS)}] ELSE {flip_list([0.5] * FLAGS)} END)"


def with_signs(spark, d, kind):
    s = response.signs(F.col("id"), kind, 1.5, FLAGS, 3, SEED, P, TOP3)
    return flags(spark, d).select("id", F.zip_with("f", s, lambda a, b: a * b).alias("f"))


TIMES = "[a[i] * b[i] FOR i IN range(1, 7)]"


@query(f"SELECT id, {TIMES} AS f FROM (SELECT id, f AS a, {IND} AS b FROM ({FLAG_ROWS}))")
def rr_independent(spark, d):
    return with_signs(spark, d, "Ind")


@query(f"SELECT id, {TIMES} AS f FROM (SELECT id, f AS a, {WEIGHTED} AS b FROM ({FLAG_ROWS}))")
def rr_weighted(spark, d):
    return with_signs(spark, d, "WeightedInd")


@query(f"SELECT id, {TIMES} AS f FROM (SELECT id, f AS a, {DEP} AS b FROM ({FLAG_ROWS}))")
def rr_dependent(spark, d):
    return with_signs(spark, d, "Dep")


def g2_sql(flips: str, cells: str) -> str:
    fill = "[" + ", ".join(q.sign("id", "fill", i) for i in range(FLAGS)) + "]"
    return (
        f"SELECT id, label * sign(membership) AS label, membership, {cells} AS f FROM (SELECT id, label, membership, CASE WHEN a IS NULL THEN fill ELSE {TIMES} END AS g "
        f"FROM (SELECT id, label, f AS a, {flips} AS b, {fill} AS fill, {q.own_membership('id', 'f IS NOT NULL', 1.0)} AS membership "
        f"FROM ({CUSTOMERS}) LEFT JOIN ({FLAG_ROWS}) USING (id))) WHERE membership <> 0"
    )


def g2(spark, d, selection_type, kind="Ind"):
    return join.join_signs(
        customers(spark, d), flags(spark, d), "id", "label", "f", FLAGS, 3, eps_memb=1.0, eps_val=2.0, kind=kind, selection=selection_type, p=P, seed=SEED
    )


def masked(weights: list[float] | None) -> str:
    keys = [q.u("id", "mask", i) if weights is None else f"-ln({q.u('id', 'mask', i)}) / {weights[i]!r}e0" for i in range(FLAGS)]
    ks = "[" + ", ".join(keys) + "]"
    return f"[g[i] * CASE WHEN ({ks})[i] <= list_sort({ks})[3] THEN 1e0 ELSE 0e0 END FOR i IN range(1, 7)]"


@query(g2_sql(IND, "[" + ", ".join(f"g[{i + 1}]" for i in TOP3) + "]"))
def join_g2_same(spark, d):
    return g2(spark, d, "Same")


@query(g2_sql(IND_UNIF, masked(None)))
def join_g2_unif(spark, d):
    return g2(spark, d, "Unif")


@query(g2_sql(IND, masked(P)))
def join_g2_nonunif(spark, d):
    return g2(spark, d, "NonUnif")


DEP_UNIF = f"(CASE WHEN {q.u('id', 'rr.row')} < {(math.exp(2) - 1) / (math.exp(2) + 2.0**3 - 1)!r}e0 THEN [{', '.join(['1e0'] * FLAGS)}] ELSE {flip_list([0.5] * FLAGS)} END)"


@query(g2_sql(WEIGHTED, "[" + ", ".join(f"g[{i + 1}]" for i in TOP3) + "]"))
def join_g2_same_weighted(spark, d):
    return g2(spark, d, "Same", "WeightedInd")


@query(g2_sql(DEP, "[" + ", ".join(f"g[{i + 1}]" for i in TOP3) + "]"))
def join_g2_same_dep(spark, d):
    return g2(spark, d, "Same", "Dep")


@query(g2_sql(DEP_UNIF, masked(None)))
def join_g2_unif_dep(spark, d):
    return g2(spark, d, "Unif", "Dep")


@query(g2_sql(DEP, masked(P)))
def join_g2_nonunif_dep(spark, d):
    return g2(spark, d, "NonUnif", "Dep")


TWO = "SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) / 1000 AS y, sum(l_quantity)::DOUBLE AS z FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


def two_columns(spark, d):
    lines = read_table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return lines.agg((F.sum("l_extendedprice") / 1000).alias("y"), F.sum("l_quantity").cast("double").alias("z"))


@query(
    f"SELECT o_orderkey, x, membership, round(coalesce(y, 0) + {q.sign('o_orderkey', 'val.y')} * {q.laplace('o_orderkey', 'val.y', 200.0)}, 6) AS y, "
    f"round(coalesce(z, 0) + {q.sign('o_orderkey', 'val.z')} * {q.laplace('o_orderkey', 'val.z', 200.0)}, 6) AS z "
    f"FROM (SELECT *, {q.own_membership('o_orderkey', 'y IS NOT NULL', 1.0)} AS membership FROM ({ORDERS}) LEFT JOIN ({TWO}) USING (o_orderkey)) WHERE membership >= 1"
)
def join_g1_two_columns(spark, d):
    out = join.join_values(orders(spark, d), two_columns(spark, d), "o_orderkey", ["y", "z"], eps_memb=1.0, eps_val=1.0, sens=100.0, seed=SEED)
    return out.select("o_orderkey", "x", "membership", r6("y", "y"), r6("z", "z"))


def bucket_sql(value: str, tag: str, noise: str) -> str:
    return (
        f"SELECT b.bucket, coalesce(s, 0) + {noise} AS value FROM (SELECT range AS bucket FROM range(128)) b "
        f"LEFT JOIN (SELECT {q.bucket('o_orderkey', tag, 128)} AS bucket, sum({q.sign('o_orderkey', tag)} * {value}) AS s FROM ({TWO}) GROUP BY 1) k USING (bucket)"
    )


@query(
    f"SELECT o_orderkey, x, membership, round(y, 4) AS y, round(z, 4) AS z FROM (SELECT o_orderkey, x, {q.sign('o_orderkey', 'memb')} * m.value AS membership, "
    f"{q.sign('o_orderkey', 'val.y')} * v.value AS y, {q.sign('o_orderkey', 'val.z')} * w.value AS z FROM ({ORDERS}) "
    f"JOIN ({bucket_sql('1e0', 'memb', q.geometric('b.bucket', 'memb', 1.0))}) m ON {q.bucket('o_orderkey', 'memb', 128)} = m.bucket "
    f"JOIN ({bucket_sql('y', 'val.y', q.laplace('b.bucket', 'val.y', 200.0))}) v ON {q.bucket('o_orderkey', 'val.y', 128)} = v.bucket "
    f"JOIN ({bucket_sql('z', 'val.z', q.laplace('b.bucket', 'val.z', 200.0))}) w ON {q.bucket('o_orderkey', 'val.z', 128)} = w.bucket) WHERE membership >= 1"
)
def join_g1_two_columns_buckets(spark, d):
    out = join.join_values(orders(spark, d), two_columns(spark, d), "o_orderkey", ["y", "z"], eps_memb=1.0, eps_val=1.0, sens=100.0, seed=SEED, buckets=128)
    return out.select("o_orderkey", "x", "membership", F.round("y", 4).alias("y"), F.round("z", 4).alias("z"))


@query()
def select_distribution(spark, d):
    p = selection.feature_distribution(flags(spark, d), "f", 1.0, SEED)
    return spark.createDataFrame(list(enumerate(p)), "feature int, p double")


OMEGA = features.Fourier.draw(WIDTH, DIM, 2.0, seed=SEED)
JL = features.projection_matrix(WIDTH, DIM, seed=SEED)


def matrix_sql(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in m[:, j]) + "]" for j in range(m.shape[1])) + "]"


def dots(m: np.ndarray) -> str:
    return f"[list_sum([x[i] * w[i] FOR i IN range(1, {WIDTH + 1})]) FOR w IN {matrix_sql(m)}]"


BETA = "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in OMEGA.beta) + "]"
RFF = f"SELECT id, label, [sqrt(2e0) * cos(g[j] + {BETA}[j]) FOR j IN range(1, {DIM + 1})] AS x FROM (SELECT id, label, {dots(OMEGA.omega)} AS g FROM ({VECTORS}))"
ROUND6 = "[round(v, 6) FOR v IN x]"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def rff(spark, d):
    return vectors(spark, d).withColumn("x", OMEGA(F.col("x")))


@query(f"SELECT id, {ROUND6} AS x FROM ({RFF})")
def rff_real(spark, d):
    return rounded(rff(spark, d), "id")


@query(
    "SELECT id, [" + ", ".join(f"CASE WHEN {q.u('id', 'round', j)} > 0.5e0 * (1e0 - x[{j + 1}] / sqrt(2e0)) THEN sqrt(2e0) ELSE -sqrt(2e0) END" for j in range(DIM)) + f"] AS x FROM ({RFF})"
)
def rff_binary(spark, d):
    return rff(spark, d).select("id", features.round_binary(F.col("x"), F.col("id"), SEED).alias("x"))


@query(
    "SELECT id, [" + ", ".join(f"CASE WHEN {q.u('id', 'round', j)} > 0.5e0 * (1e0 - x[{j + 1}] / sqrt(2e0)) THEN 1e0 ELSE 0e0 END" for j in range(DIM)) + f"] AS x FROM ({RFF})"
)
def rff_zero_one(spark, d):
    return rff(spark, d).select("id", features.round_binary(F.col("x"), F.col("id"), SEED, 0.0, 1.0).alias("x"))


@query(f"SELECT id, [round(v, 6) FOR v IN {dots(JL)}] AS x FROM ({VECTORS})")
def jl_project(spark, d):
    return rounded(vectors(spark, d).withColumn("x", features.project(F.col("x"), JL)), "id")


def g3(spark, d, kind):
    known = vectors(spark, d).select("id", "label")
    private = prep.subsample(rff(spark, d), "id", 0.7, SEED).select("id", "x")
    return join.join_features(known, private, "id", "label", "x", DIM, eps_memb=1.0, eps_val=5.0, data_type=kind, seed=SEED)


def g3_sql(cells: str) -> str:
    return (
        f"SELECT id, (label * sign(membership))::DOUBLE AS label, membership, [round(v, 6) FOR v IN {cells}] AS x FROM (SELECT k.id, k.label, p.x, "
        f"{q.own_membership('k.id', 'p.id IS NOT NULL', 1.0)} AS membership FROM ({VECTORS}) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {q.u('id', 'sample')}, id) AS r FROM ({RFF})) WHERE r <= round((SELECT count(*) FROM ({VECTORS})) * 0.7e0)) p ON k.id = p.id) WHERE membership <> 0"
    )


NOISY = [f"coalesce(x[{j + 1}], 0e0) + {q.laplace('id', 'feat', math.sqrt(2) * DIM / 5.0, j)}" for j in range(DIM)]
BINARY = [
    f"coalesce(x[{j + 1}], {q.sign('id', 'fill', j)} * sqrt(2e0)) * CASE WHEN {q.u('id', 'feat', j)} < {response.flip_probability(1.0)!r}e0 THEN -1e0 ELSE 1e0 END"
    for j in range(DIM)
]


@query(g3_sql("[" + ", ".join(NOISY) + "]"))
def join_g3_real(spark, d):
    return rounded(g3(spark, d, "Real"), "id", "label", "membership")


@query(g3_sql("[" + ", ".join(f"greatest(least({c}, sqrt(2e0)), -sqrt(2e0))" for c in NOISY) + "]"))
def join_g3_real_clip(spark, d):
    return rounded(g3(spark, d, "Real Clip"), "id", "label", "membership")


@query(g3_sql("[" + ", ".join(BINARY) + "]"))
def join_g3_binary(spark, d):
    return rounded(g3(spark, d, "Binary"), "id", "label", "membership")


# ---------------------------------------------------------------- matrices, bandwidths

CELLS = f"SELECT id, unnest(range(len(x)))::INTEGER AS i, unnest(x) AS v FROM ({VECTORS})"


@query(f"WITH c AS ({CELLS}) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS value FROM c a JOIN c b ON a.id = b.id GROUP BY ALL")
def gram_matrix(spark, d):
    return features.gram_cells(vectors(spark, d), "x").select("i", "j", r6("value", "value"))


@query(f"SELECT i, max(abs(v)) AS sens FROM ({CELLS}) GROUP BY i")
def sens_list(spark, d):
    return features.sensitivities(vectors(spark, d), "x")


@query(f"WITH c AS ({CELLS}), m AS (SELECT i, avg(v) AS m FROM c GROUP BY i) SELECT i, round(max(abs(v - m)), 6) AS sens FROM c JOIN m USING (i) GROUP BY i")
def sens_list_centered(spark, d):
    return features.sensitivities(vectors(spark, d), "x", centred=True).select("i", r6("sens", "sens"))


@query(f"SELECT i, max(v) AS top, round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(v, 0.05), 6) AS q05, min(v) AS low FROM ({CELLS}) GROUP BY i")
def quantile_report(spark, d):
    return features.quantile_report(vectors(spark, d), "x").select("i", "top", r6("q95", "q95"), r6("q05", "q05"), "low")


def basis_rows(spark, basis):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(basis.vectors)], "i int, components array<double>")


@query()
def pca_gram(spark, d):
    return basis_rows(spark, features.pca(vectors(spark, d), "x", 3))


@query()
def pca_centred(spark, d):
    return basis_rows(spark, features.pca(vectors(spark, d), "x", 3, centred=True))


@query()
def private_pca_laplace(spark, d):
    return basis_rows(spark, features.private_pca_laplace(vectors(spark, d), "x", 3, 5.0, SEED))


@query()
def private_pca_power(spark, d):
    return basis_rows(spark, features.private_pca_power(vectors(spark, d), "x", 3, 5.0, 10, None, SEED))


@query(f"WITH s AS ({VECTORS}) SELECT round(quantile_cont(list_distance(a.x, b.x), 0.5), 6) AS bandwidth FROM s a JOIN s b ON a.id < b.id")
def bandwidth_median(spark, d):
    return bandwidth.median_of_all(vectors(spark, d), "id", "x").select(r6("bandwidth", "bandwidth"))


ORDER_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_custkey"]
ORDER_CATEGORIES = " UNION ALL ".join(f"SELECT o_orderkey AS id, '{c}=' || {c} AS name FROM orders" for c in ORDER_COLUMNS)


@query(f"WITH c AS ({ORDER_CATEGORIES}) SELECT a.name AS a, b.name AS b, count(*)::DOUBLE AS value FROM c a JOIN c b ON a.id = b.id AND a.name <= b.name GROUP BY ALL")
def gram_one_hot(spark, d):
    """Gram matrix of one-hot orders, a column for each status, priority and customer: its cells that aren't 0."""
    rows, known, _ = wide.sparse_one_hot(read_table(spark, d, "orders"), "o_orderkey", ORDER_COLUMNS, SEED)
    name = known.select("index", F.concat_ws("=", "column", "category").alias("name"))
    met = wide.sparse_gram(rows).join(name.toDF("i", "x"), "i").join(name.toDF("j", "y"), "j")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "value")


@query()
def pca_one_hot(spark, d):
    """The three largest eigenvalues of the covariance of one-hot orders and each category's squared loading: no p by p matrix is held."""
    rows, known, width = wide.sparse_one_hot(read_table(spark, d, "orders"), "o_orderkey", ORDER_COLUMNS, SEED)
    found, values = wide.components(rows, width, 3, centred=True)
    eigenvalue = F.get(F.lit([float(v) for v in values]), F.col("component"))
    loadings = found.select("index", F.posexplode("lead").alias("component", "v")).select("index", "component", eigenvalue.alias("eigenvalue"), (F.col("v") * F.col("v")).alias("loading"))
    return known.join(loadings, "index").select("column", "category", "component", r6("eigenvalue", "eigenvalue"), r6("loading", "loading"))


@query(SQL["bandwidth_median"])
def bandwidth_median_pruned(spark, d):
    found, _ = cells.median_by_cells(vectors(spark, d), "id", "x")
    return bandwidth.one_figure(spark, [] if found is None else [found]).select(r6("bandwidth", "bandwidth"))


SAMPLE1000 = f"SELECT id, x FROM ({VECTORS}) ORDER BY {q.u('id', 'bandwidth')}, id LIMIT 1000"


@query(f"WITH s AS ({SAMPLE1000}) SELECT round(quantile_cont(list_distance(a.x, b.x), 0.5), 6) AS bandwidth FROM s a JOIN s b ON a.id < b.id")
def bandwidth_median_sampled(spark, d):
    return bandwidth.median_distance(vectors(spark, d), "id", "x", seed=SEED).select(r6("bandwidth", "bandwidth"))


@query(
    f"WITH t AS (SELECT id, x, row_number() OVER (ORDER BY {q.u('id', 'place')}, id) - 1 AS place FROM ({VECTORS})), "
    f"s AS (SELECT g // 10000 AS i, floor({q.u('g', 'bootstrap')} * (SELECT count(*) FROM t))::BIGINT AS place, count(*) AS n FROM range(100000) AS r(g) GROUP BY ALL), "
    "h AS (SELECT * FROM s JOIN t USING (place)), "
    "p AS (SELECT a.i, list_distance(a.x, b.x) AS v, a.n * b.n AS n FROM h a JOIN h b ON a.i = b.i AND a.id < b.id UNION ALL SELECT i, 0, n * (n - 1) // 2 FROM h WHERE n > 1), "
    "c AS (SELECT i, v, sum(n) OVER (PARTITION BY i ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY i) AS whole FROM p) "
    "SELECT round(avg(m), 6) AS bandwidth FROM (SELECT i, (min(v) FILTER (upto > floor((whole - 1) / 2)) + min(v) FILTER (upto > ceil((whole - 1) / 2))) / 2 AS m FROM c GROUP BY i)"
)
def bandwidth_mean_of_medians(spark, d):
    return bandwidth.mean_of_medians(vectors(spark, d), "id", "x", seed=SEED).select(r6("bandwidth", "bandwidth"))


@query(f"SELECT round(sqrt((max(i) + 1) * var_pop(v)), 6) AS bandwidth FROM ({CELLS})")
def bandwidth_var(spark, d):
    return bandwidth.variance_bandwidth(vectors(spark, d), "x").select(r6("bandwidth", "bandwidth"))


# ---------------------------------------------------------------- regression, models, sweeps

H = join.invention_rate(1.0)
KEPT = f"SELECT * FROM ({G1}) WHERE membership >= 1"
SUMS = f"SELECT sum(x * x) AS xx, sum(x * y) AS xy, count(*)::DOUBLE AS m, (SELECT count(*) FROM orders)::DOUBLE AS n, (SELECT sum(x * x) FROM ({ORDERS})) AS ff, {H!r}::DOUBLE AS h FROM ({KEPT})"


def slope(spark, value):
    return spark.createDataFrame([(round(float(value), 6),)], "slope double")


@query(f"SELECT round(sum(x * y) / sum(x * x), 6) AS slope FROM ({ORDERS}) JOIN ({RETURNED}) USING (o_orderkey)")
def ols_control(spark, d):
    return slope(spark, regression.ols(orders(spark, d).join(returned(spark, d), "o_orderkey"), ["x"], "y")[0])


@query(f"SELECT round((m - h * n) / (1 - 2 * h), 6) AS size FROM ({SUMS})")
def join_size_estimate(spark, d):
    sizes = g1(spark, d).agg(F.count(F.lit(1)).alias("m")).crossJoin(orders(spark, d).agg(F.count(F.lit(1)).alias("n")))
    return sizes.select(r6((F.col("m") - F.lit(H) * F.col("n")) / F.lit(1 - 2 * H), "size"))


@query(f"SELECT round(xy / (xx * (m - h * (n - (m - h * n) / (1 - 2 * h))) / m), 6) AS slope FROM ({SUMS})")
def ols_oblivious(spark, d):
    return slope(spark, regression.oblivious(g1(spark, d), ["x"], "y", orders(spark, d).count(), H)[0])


@query(f"SELECT round(xy / ((xx - h * ff) * (1 - h) / (1 - 2 * h)), 6) AS slope FROM ({SUMS})")
def ols_datadep(spark, d):
    return slope(spark, regression.data_dependent(g1(spark, d), ["x"], "y", orders(spark, d), H)[0])


@query(f"SELECT round(xy / (xx - m * 2 * (0.5e0 / 1e0) ** 2), 6) AS slope FROM ({SUMS})")
def ols_noisy_features(spark, d):
    df = g1(spark, d)
    return slope(spark, regression.noisy_features(df, ["x"], "y", df.count(), 0.5, 1.0)[0])


@query(
    f"WITH a AS (SELECT o_orderkey, o_totalprice / 1000 AS x, o_custkey / 1000e0 AS v FROM orders), k AS (SELECT a.*, y FROM a JOIN ({KEPT}) USING (o_orderkey)), "
    f"f AS (SELECT sum(x * x) AS xx, sum(x * v) AS xv, sum(v * v) AS vv FROM a), s AS (SELECT sum(x * x) AS xx, sum(x * v) AS xv, sum(v * v) AS vv, sum(x * y) AS xy, sum(v * y) AS vy FROM k), "
    f"m AS (SELECT (s.xx - {H!r} * f.xx) * c AS a, (s.xv - {H!r} * f.xv) * c AS b, (s.vv - {H!r} * f.vv) * c AS d, xy, vy FROM s, f, (SELECT {(1 - H) / (1 - 2 * H)!r}::DOUBLE AS c)) "
    "SELECT round((d * xy - b * vy) / (a * d - b * b), 5) AS slope_x, round((a * vy - b * xy) / (a * d - b * b), 5) AS slope_v FROM m"
)
def ols_two_features(spark, d):
    more = read_table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") / 1000).alias("v"))
    known = orders(spark, d).join(more, "o_orderkey")
    x, v = regression.data_dependent(g1(spark, d).join(more, "o_orderkey"), ["x", "v"], "y", known, H)
    return spark.createDataFrame([(round(float(x), 5), round(float(v), 5))], "slope_x double, slope_v double")


@query(f"WITH j AS (SELECT x, y FROM ({ORDERS}) JOIN ({RETURNED}) USING (o_orderkey)) SELECT round(avg((x * (SELECT sum(x * y) / sum(x * x) FROM j) - y) ** 2), 6) AS mse FROM j")
def mse(spark, d):
    df = orders(spark, d).join(returned(spark, d), "o_orderkey")
    beta = regression.ols(df, ["x"], "y")
    return regression.mse(df, regression.predict(["x"], beta), "y").select(r6("mse", "mse"))


TRAIN_TEST = f"WITH v AS (SELECT *, {q.u('id', 'split')} < 0.8e0 AS train FROM ({VECTORS}))"


def train_test(spark, d):
    df = vectors(spark, d)
    df = df.withColumns({"train": prep.hash_split(df, "id", 0.8, SEED), "label": F.col("label").cast("double")})
    return df.filter("train").drop("train"), df.filter("not train").drop("train")


KNN = (
    TRAIN_TEST + ", p AS (SELECT t.id, n.label, row_number() OVER (PARTITION BY t.id ORDER BY round(list_sum([(t.x[i] - n.x[i]) * (t.x[i] - n.x[i]) FOR i IN range(1, " + str(WIDTH + 1) + ")]), 9), n.id) AS r "
    "FROM v t JOIN v n ON n.train AND NOT t.train), k AS (SELECT id, CASE WHEN sum(label) >= 0 THEN 1e0 ELSE -1e0 END AS predicted FROM p WHERE r <= 5 GROUP BY id) "
)


@query(KNN + "SELECT v.id, v.label::DOUBLE AS label, predicted FROM v JOIN k USING (id) WHERE NOT train")
def knn_vote(spark, d):
    train, test = train_test(spark, d)
    return models.nearest_votes(train, test).select("id", "label", "predicted")


@query(SQL["knn_vote"])
def knn_vote_pruned(spark, d):
    train, test = train_test(spark, d)
    return cells.pruned_votes(train, test).select("id", "label", "predicted")


@query(KNN + "SELECT round(avg((predicted = v.label)::INTEGER), 6) AS accuracy FROM v JOIN k USING (id) WHERE NOT train")
def accuracy(spark, d):
    train, test = train_test(spark, d)
    out = models.nearest_votes(train, test)
    return regression.accuracy(out, F.col("predicted"), "label").select(r6("accuracy", "accuracy"))


@query()
def model_accuracies(spark, d):
    train, test = train_test(spark, d)
    if train.select("label").distinct().count() < 2:  # nothing to fit
        return spark.createDataFrame([(name, None) for name in models.MODELS], "model string, accuracy double")
    rows = [(name, regression.accuracy(fit(train)(test), F.col("predicted"), "label").first().accuracy) for name, fit in models.MODELS.items()]
    return spark.createDataFrame(rows, "model string, accuracy double")


TTC_VOTES = (
    f"SELECT id, CASE WHEN list_sum([CASE WHEN c = 1 THEN ({P!r})[i] ELSE 0 END FOR c, i IN cs]) > 0.5e0 THEN 1e0 ELSE -1e0 END AS vote FROM (SELECT id, t, ["
    + ", ".join(f"greatest(CASE WHEN {q.u('id', 'ttc', 't', i)} < {response.flip_probability(1.0)!r}e0 THEN -f[{i + 1}] ELSE f[{i + 1}] END, 0e0)" for i in range(FLAGS))
    + f"] AS cs FROM ({FLAG_ROWS}), range(201) AS r(t))"
)


@query(f"SELECT id, quantile_cont(vote, 0.5) AS predicted FROM ({TTC_VOTES}) GROUP BY id")
def ttc_median_vote(spark, d):
    score = lambda x: F.when(features.dot(x, features.doubles(P)) > 0.5, 1.0).otherwise(-1.0)
    return models.corrected_votes(flags(spark, d), "f", 1.0, score, 201, SEED)


@query()
def ttc_fitted_vote(spark, d):
    """The median prediction of a tree, fitted to whole rows, over noisy copies of the rows held out."""
    split = sign_split(spark, d)
    fitted = models.MODELS["DecisionTree"](split.known.join(split.private, "id").withColumn("x", F.transform("x", lambda v: F.greatest(v, F.lit(0.0)))))
    return models.corrected_predictions(split.test, "x", 1.0, fitted, 201, SEED)


def trial_rows(spark, d):
    """Membership joins of ten trials: kept known rows by trial and eps."""
    grid = spark.range(10).withColumnRenamed("id", "trial").crossJoin(spark.createDataFrame([(1.0,), (2.0,)], "eps double"))
    known = join.joined(docs(spark, d), labels(spark, d), "doc_id").crossJoin(F.broadcast(grid))
    z = lambda eps: sketch.own_membership(F.col("doc_id"), F.col("_in"), eps, SEED, F.col("trial"))
    kept = known.filter(F.when(F.col("eps") == 1.0, z(1.0)).otherwise(z(2.0)) >= 1)
    return kept.groupBy("eps", "trial").agg(F.avg(F.col("_in").cast("double")).alias("value"))


def trial_membership(eps: float) -> str:
    return f"((CASE WHEN l.doc_id IS NOT NULL THEN 1e0 ELSE 0e0 END) + {q.sign('d.doc_id', 'memb', 't')} * {q.geometric('d.doc_id', 'memb', eps, 't')})"


TRIALS = (
    "SELECT eps, t AS trial, avg((l.doc_id IS NOT NULL)::INTEGER) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, range(10) AS r(t), "
    f"(VALUES (1e0), (2e0)) AS e(eps) WHERE CASE WHEN eps = 1 THEN {trial_membership(1.0)} ELSE {trial_membership(2.0)} END >= 1 GROUP BY ALL"
)


@query(
    f"SELECT eps, round(m, 6) AS median, round(m - a, 6) AS low, round(b - m, 6) AS high FROM (SELECT eps, quantile_cont(value, 0.5) AS m, "
    f"quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM ({TRIALS}) GROUP BY eps)"
)
def sweep_median_offsets(spark, d):
    return sweep.median_offsets(trial_rows(spark, d), ["eps"]).select("eps", r6("median", "median"), r6("low", "low"), r6("high", "high"))


@query(f"SELECT eps, trial, round(value / 0.8e0, 6) AS ratio FROM ({TRIALS})")
def ratio_to_control(spark, d):
    return sweep.ratio_to_control(trial_rows(spark, d), ["eps", "trial"], 0.8).select("eps", "trial", r6("ratio", "ratio"))


def sign_split(spark, d):
    """Customers' labels and flags, split by customer."""
    known, private = customers(spark, d), flags(spark, d).withColumnRenamed("f", "x")
    train = prep.hash_split(known, "id", 0.8, SEED)
    return ex.Split(known.filter(train), private.filter(train), known.filter(~train).join(private, "id"))


def vector_split(spark, d):
    """Known labels of all training vectors; the private side lacks three in four of one class."""
    train, test = train_test(spark, d)
    centred = [F.transform("x", lambda v, i: v - F.get(F.lit(list(map(float, features.column_means(train, "x", width(train))[0]))), i)).alias("x")]
    private = prep.biased_subsample(train, "id", "label", 1.0, SEED)
    return ex.Split(train.select("id", "label"), private.select("id", *centred), test.select("id", "label", *centred))


def median_trials(spark: SparkSession, settings: list[dict], trial: Callable[..., DataFrame]) -> DataFrame:
    """Median and quartile offsets of 25 trials of each setting, all in one job."""
    found = sweep.run_grid(spark, [s | {"trial": t} for s in settings for t in range(25)], trial)
    return sweep.median_offsets(found, list(settings[0]))


@query()
def sweep_sign_variants(spark, d):
    split = sign_split(spark, d)
    p = selection.feature_distribution(split.private, "x", 0.5, SEED)
    settings = [s | {"k": 3} for s in sweep.grid(variant=sweep.SEVEN_VARIANTS, eps=[1.0, 3.0])]
    rows = [{"kind": s["variant"][0], "selection_type": s["variant"][1], "k": s["k"], "eps": s["eps"]} for s in settings]
    return median_trials(spark, rows, ex.SignTrials(split, FLAGS, p, rows, "BernoulliNB"))


@query()
def sweep_sign_columns(spark, d):
    split = sign_split(spark, d)
    p = selection.feature_distribution(split.private, "x", 0.5, SEED)
    rows = [{"kind": a, "selection_type": b, "k": k, "eps": 3.0} for k in (1, 3, FLAGS) for a, b in sweep.four_variants(k, FLAGS)]
    return median_trials(spark, rows, ex.SignTrials(split, FLAGS, p, rows, "BernoulliNB"))


@query()
def sweep_pca(spark, d):
    split = vector_split(spark, d)
    return median_trials(spark, sweep.grid(method=["power", "laplace"], dim=[2, 4], eps=[2.0, 8.0]), lambda **s: ex.pca_trial(split, "GaussianNB", **s))


@query()
def sweep_pca_iterations(spark, d):
    split = vector_split(spark, d)
    return median_trials(spark, sweep.grid(iterations=[1, 5, 20], dim=[3], eps=[8.0]), lambda **s: ex.pca_trial(split, "GaussianNB", **s))


@query()
def sweep_fourier(spark, d):
    split = vector_split(spark, d)
    cells = width(split.test)
    return median_trials(spark, sweep.grid(data_type=["Real Clip", "Binary"], dim=[DIM], eps=[2.0, 8.0]), lambda **s: ex.fourier_trial(split, cells, "GaussianNB", **s))


@query()
def sweep_bandwidths(spark, d):
    split = vector_split(spark, d)
    cells = width(split.test)
    return median_trials(spark, sweep.grid(bandwidth=[0.5, 1.0, 2.0], dim=[8]), lambda **s: ex.open_trial(split, cells, "GaussianNB", "fourier", **s))


@query()
def sweep_without_privacy(spark, d):
    split = vector_split(spark, d)
    cells = width(split.test)
    return median_trials(spark, sweep.grid(method=["fourier", "pca"], dim=[2, 6]), lambda **s: ex.open_trial(split, cells, "GaussianNB", **s))


def trial_sums(eps: float) -> str:
    """Sums over the kept rows of 25 trials of a private join, half of eps each for membership and values."""
    e = eps / 2
    return (
        f"SELECT {eps!r}::DOUBLE AS eps, {join.invention_rate(e)!r}::DOUBLE AS h, t, sum(x * x) AS xx, sum(x * y) AS xy, count(*)::DOUBLE AS m FROM (SELECT t, x, "
        f"coalesce(y, 0) + {q.sign('o.id', 'val.y', seed='t')} * {q.laplace('o.id', 'val.y', 100.0 / e, seed='t')} AS y, "
        f"{q.own_membership('o.id', 'r.id IS NOT NULL', e, seed='t')} AS z FROM o LEFT JOIN r ON o.id = r.id, range(25) AS k(t) WHERE train) WHERE z >= 1 GROUP BY t"
    )


@query(
    f"WITH o AS (SELECT o_orderkey AS id, x, {q.u('o_orderkey', 'split')} < 0.5e0 AS train FROM ({ORDERS})), r AS (SELECT o_orderkey AS id, y FROM ({RETURNED})), "
    "w AS (SELECT id, x, y, train FROM o JOIN r USING (id)), c AS (SELECT sum(x * y) / sum(x * x) AS b FROM w WHERE train), "
    "t AS (SELECT sum(x * x) AS txx, sum(x * y) AS txy, sum(y * y) AS tyy, count(*)::DOUBLE AS tn, avg((x * (SELECT b FROM c) - y) ** 2) AS control FROM w WHERE NOT train), "
    f"f AS (SELECT sum(x * x) AS ff, count(*)::DOUBLE AS n FROM o WHERE train), s AS ({trial_sums(2.0)} UNION ALL {trial_sums(4.0)}), "
    "z AS (SELECT *, (m - h * n) / (1 - 2 * h) AS size FROM s, f), b AS ("
    "SELECT 'plain' AS estimator, eps, xy / xx AS b FROM z UNION ALL SELECT 'oblivious', eps, xy / (xx * (m - h * (n - size)) / m) FROM z "
    "UNION ALL SELECT 'datadep', eps, xy / ((xx - h * ff) * ((1 - h) / (1 - 2 * h))) FROM z), "
    "v AS (SELECT estimator, eps, (b * b * txx - 2 * b * txy + tyy) / tn / control AS value FROM b, t), "
    "g AS (SELECT estimator, eps, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.25) AS low, quantile_cont(value, 0.75) AS high FROM v GROUP BY ALL) "
    "SELECT estimator, eps, round(m, 6) AS ratio, round(m - low, 6) AS low, round(high - m, 6) AS high FROM g"
)
def sweep_regression(spark, d):
    """Median error of 25 trials by estimator and eps and its quartile offsets, as ratios to the error of the inner join."""
    rows = orders(spark, d).withColumnRenamed("o_orderkey", "id")
    train = prep.hash_split(rows, "id", 0.5, SEED)
    private = returned(spark, d).withColumnRenamed("o_orderkey", "id")
    known, whole = rows.filter(train), rows.join(private, "id")
    part, test = whole.filter(train).select("id", "y"), whole.filter(~train)
    control = regression.mse(test, regression.predict(["x"], regression.ols(whole.filter(train), ["x"], "y")), "y").first().mse
    found = median_trials(spark, sweep.grid(estimator=["plain", "oblivious", "datadep"], eps=[2.0, 4.0]), lambda **s: ex.regression_trial(known, part, test, sens=100.0, **s))
    return found.select("estimator", "eps", *[r6(F.col(c) / control, n) for c, n in (("median", "ratio"), ("low", "low"), ("high", "high"))])


def streamed_sums(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The final sums of the stream of events: a row a day and bucket, from the complete output of all batches."""
    schema = read_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    sums = stream_member_sketch(stream, "user_id", "ts", 32, SEED, late="3650 days")
    name = f"{name}_{abs(hash(d)) % 10**8}"
    sums.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


STREAMED = f"SELECT w, {q.bucket('user_id', 'memb', 32)} AS bucket, sum({q.sign('user_id', 'memb')}) AS value FROM (SELECT DISTINCT user_id, date_trunc('day', ts) AS w FROM events) GROUP BY ALL"


@query(f"SELECT bucket, sum(value) AS value FROM ({STREAMED}) GROUP BY 1")
def stream_membership(spark, d):
    return streamed_sums(spark, d, "stream_membership").groupBy("bucket").agg(F.sum("value").alias("value"))


@query(
    f"WITH s AS ({STREAMED}), e AS (SELECT DISTINCT w, b AS bucket FROM s, range(32) AS r(b)) SELECT epoch(e.w)::BIGINT AS start, e.bucket, "
    f"coalesce(value, 0e0) + {q.geometric("epoch(e.w)::BIGINT || ':' || e.bucket", 'memb', 1.0)} AS value FROM e LEFT JOIN s ON e.w = s.w AND e.bucket = s.bucket"
)
def stream_membership_release(spark, d):
    """What may be published of the final days: all buckets of each, with noise."""
    out = add_noise(streamed_sums(spark, d, "stream_membership_release"), 1.0, 32, SEED)
    return out.select(F.col("start").cast("bigint").alias("start"), "bucket", "value")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A private join of orders with their returned value, and the corrected slope beside each kept row."""
    kept = g1(spark, d)
    beta = regression.data_dependent(kept, ["x"], "y", orders(spark, d), H)
    return kept.withColumn("predicted", regression.predict(["x"], beta))

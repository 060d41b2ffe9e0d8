"""Queries over categories, neighbours and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions.hashing import hash_word_sql
from flowquarry.functions.numeric import round6
from flowquarry.operators import balance as B
from flowquarry.operators import encoding as E
from flowquarry.operators.neighbours import nearest
from flowquarry.plans.registry import query
from flowquarry.sources import tables as S

VEC_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS pid, a.label, b.label AS plabel,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id AND {on})"""
KNN_SQL = (
    VEC_SQL.format(on="a.label = b.label")
    + ", knn AS (SELECT qid, pid, label, d, row_number() OVER (PARTITION BY qid ORDER BY d, pid)::int AS position FROM pairs QUALIFY position <= 5)"
)


def vectors(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query(f"WITH {KNN_SQL} SELECT qid AS vec_id, pid AS neighbour, position, round(d, 6) AS distance FROM knn")
def knn_within_class(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("e").alias("vec"))
    found = nearest(v, v, 5, same_table=True)
    return found.select(F.col("qid").alias("vec_id"), F.col("pid").alias("neighbour"), "position", round6(F.col("distance")).alias("distance"))


@query(f"""WITH {VEC_SQL.format(on="a.label <> 0 AND b.label = 0")} SELECT qid AS vec_id, pid AS neighbour, round(d, 6) AS distance FROM pairs
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, pid) = 1""")
def counterfactual_nun(spark, sf_dir):
    found = B.nearest_unlike(vectors(spark, sf_dir), "vec_id", "label", F.col("e"), 0)
    return found.select(F.col("qid").alias("vec_id"), F.col("pid").alias("neighbour"), round6(F.col("distance")).alias("distance"))


SMOTE_SQL = (
    KNN_SQL
    + f""", c AS (SELECT label, count(*) AS n FROM v GROUP BY label), t AS (SELECT *, (SELECT max(n) FROM c) - n AS need FROM c),
o AS (SELECT v.*, n, need, row_number() OVER (PARTITION BY v.label ORDER BY {hash_word_sql("vec_id", 0)}, {hash_word_sql("vec_id", 1)}) AS rn FROM v JOIN t USING (label) WHERE need > 0),
s AS (SELECT *, unnest(range(1, (need // n + (rn <= need % n)::int) + 1)) AS copy FROM o),
d AS (SELECT vec_id AS seed, label, copy, e, n, {hash_word_sql("vec_id || '#' || copy", 0)} % least(5, n - 1) + 1 AS pick, {hash_word_sql("vec_id || '#' || copy", 1)} / 4294967296.0::double AS u FROM s),
syn AS (SELECT d.seed, d.label, d.copy::int AS copy, k.pid AS neighbour, u, list_transform(range(1, 65), lambda i: d.e[i] + u * (b.e[i] - d.e[i])) AS x
  FROM d JOIN knn k ON k.qid = d.seed AND k.position = d.pick JOIN v b ON b.vec_id = k.pid)"""
)


@query(f"""WITH {SMOTE_SQL} SELECT seed, label, copy, neighbour, round(u, 6) AS u, round(x[1], 6) + 0.0 AS x0, round(x[64], 6) + 0.0 AS x63, round(list_sum(x), 6) + 0.0 AS total FROM syn""")
def smote(spark, sf_dir):
    names = [f"e{i}" for i in range(64)]
    df = vectors(spark, sf_dir).select("vec_id", "label", *[F.col("e")[i].alias(n) for i, n in enumerate(names)])
    rows = B.smote(df, "vec_id", "label", names)
    total = sum([F.col(n) for n in names[1:]], F.col(names[0]))
    return rows.select(
        "seed", "label", "copy", "neighbour", round6(F.col("u")).alias("u"), round6(F.col("e0")).alias("x0"),
        round6(F.col("e63")).alias("x63"), round6(total).alias("total"),
    )


@query("""WITH c AS (SELECT quality::varchar || toxic::varchar AS label, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT floor(max(n) * 0.25)::bigint AS target FROM c)
  SELECT label, n, CASE WHEN n < target THEN target ELSE n END AS target FROM c, t""")
def soft_smote_targets(spark, sf_dir):
    from pyspark.sql import Window

    counts = S.table(spark, sf_dir, "labels").groupBy(F.concat(F.col("quality"), F.col("toxic")).alias("label")).agg(F.count("*").alias("n"))
    target = F.floor(F.max("n").over(Window.partitionBy()) * 0.25)
    return counts.select("label", "n", F.greatest("n", target).alias("target"))


@query()
def soft_smote(spark, sf_dir):
    names = [f"e{i}" for i in range(64)]
    df = vectors(spark, sf_dir).select(
        "vec_id", F.when(F.col("label") == 3, "rare").otherwise("common").alias("kind"), *[F.col("e")[i].alias(n) for i, n in enumerate(names)]
    )
    return B.smote(df, "vec_id", "kind", names, B.soft_targets(B.class_counts(df, "kind"))).select("seed", "copy", "neighbour", "kind", "u", "e0", "e63")


@query()
def smote_nc(spark, sf_dir):
    # Six part types as classes, brand as the category, price and size as numbers.
    df = S.table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("p_size")
    )
    return B.smote_nc(df, "p_partkey", "p_type", ["p_retailprice", "p_size"], {"p_brand": E.categories(df, "p_brand")})


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS type_code, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code FROM part")
def label_encode(spark, sf_dir):
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    df = E.encode(part, "p_type", E.code_table(part, "p_type"), "type_code")
    df = E.encode(df, "p_brand", E.code_table(part, "p_brand"), "brand_code")
    return df.select("p_partkey", "type_code", "brand_code")


@query("""WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 2 AND p_type = 'PROMO'))
  SELECT p_partkey, coalesce(code, 0) AS brand_code FROM part LEFT JOIN r USING (p_brand)""")
def encode_unseen(spark, sf_dir):
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    codes = E.code_table(part.filter("p_size <= 2 and p_type = 'PROMO'"), "p_brand")
    return E.encode(part, "p_brand", codes, "brand_code", unknown=0).select("p_partkey", "brand_code")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"""SELECT p_partkey, {", ".join(f"(p_type = '{t}' AND p_size <= 30)::int AS type_{t}" for t in _TYPES)} FROM part""")
def one_hot(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    values = E.categories(part.filter("p_size <= 30"), "p_type")
    # Sizes above 30 carry a value training never saw.
    shown = part.withColumn("p_type", F.when(F.col("p_size") <= 30, F.col("p_type")).otherwise("NEW"))
    return E.one_hot(shown, "p_type", values, "type").select("p_partkey", *[f"type_{v}" for v in values])


@query(f"""SELECT p_partkey, {", ".join(f"(p_size <= 45 AND p_type = '{t}')::int AS p_type_{t}" for t in _TYPES)}, (p_size > 45)::int AS p_type_nan FROM part""")
def dummies_with_null(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    gappy = part.select("p_partkey", F.when(F.col("p_size") <= 45, F.col("p_type")).alias("p_type"))
    return E.dummies(gappy, "p_type", E.categories(gappy, "p_type"))

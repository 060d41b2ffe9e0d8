"""Queries over the scalar functions in use, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions.features import title_of
from flowquarry.functions.numeric import round6, safe_log1p
from flowquarry.plans.registry import query
from flowquarry.sources import tables as S


@query("""SELECT doc_id, lower(lang) || '-' || upper(source) AS tag, md5(lower(text)) AS lowered, starts_with(text, 'The')::int AS starts_the,
  contains(lower(text), 'ation')::int AS has_ation, length(replace(text, ' ', '_')) AS n_chars_again, length(trim(text)) AS trimmed,
  regexp_extract(source, '([0-9]+)$', 1) AS source_no, printf('%s has %d chars', source, n_chars) AS sentence,
  upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS title FROM documents""")
def scalar_strings(spark, sf_dir):
    text = F.col("text")
    return S.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lower("lang"), F.lit("-"), F.upper("source")).alias("tag"),
        F.md5(F.lower(text).cast("binary")).alias("lowered"),
        text.startswith("The").cast("int").alias("starts_the"),
        F.lower(text).contains("ation").cast("int").alias("has_ation"),
        F.length(F.replace(text, F.lit(" "), F.lit("_"))).cast("bigint").alias("n_chars_again"),
        F.length(F.trim(text)).cast("bigint").alias("trimmed"),
        F.regexp_extract("source", "([0-9]+)$", 1).alias("source_no"),
        F.format_string("%s has %d chars", "source", "n_chars").alias("sentence"),
        title_of(F.concat_ws("_", "lang", "source")).alias("title"),
    )


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(l_quantity - 25) AS gap, round(ln(1 + l_extendedprice), 6) AS log_price,
  round(sqrt(l_extendedprice), 6) AS root, floor(l_extendedprice / 1000)::bigint AS thousands, trunc(l_quantity / 7)::int AS truncated,
  greatest(l_quantity, 30.0::double) AS at_least, least(l_quantity, 30.0::double) AS at_most,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) + 0.0 END AS ratio FROM lineitem""")
def scalar_math(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.abs(q - 25).alias("gap"), F.round(safe_log1p(p), 6).alias("log_price"), F.round(F.sqrt(p), 6).alias("root"),
        F.floor(p / 1000).alias("thousands"), (q / 7).cast("int").alias("truncated"),
        F.greatest(q, F.lit(30.0)).alias("at_least"), F.least(q, F.lit(30.0)).alias("at_most"),
        (F.round(F.try_divide("l_tax", "l_discount"), 4) + 0.0).alias("ratio"),
    )


@query("""SELECT event_id, ts - INTERVAL 5 SECOND AS cutoff, ts - INTERVAL 60 MINUTE AS hour_ago, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
  extract(hour FROM ts)::int AS hour, date_trunc('day', ts)::timestamp AS day, (epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) // 1000000 AS seconds_in FROM events""")
def scalar_dates(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events").select("event_id", "ts")
    start = ev.agg(F.unix_micros(F.min("ts").cast("timestamp"))).scalar()
    return ev.select(
        "event_id", (F.col("ts") - F.expr("interval 5 seconds")).alias("cutoff"),
        (F.col("ts") - F.expr("interval 60 minutes")).alias("hour_ago"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.hour("ts").alias("hour"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 1000000).alias("seconds_in"),
    )


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings)
  SELECT vec_id, len(e)::int AS n, round(e[1], 6) + 0.0 AS first, round(list_max(e), 6) + 0.0 AS largest, (list_position(e, list_max(e)) - 1)::bigint AS argmax,
  round(list_sum(e) / len(e), 6) + 0.0 AS mean, round(list_sort(e)[1], 6) + 0.0 AS smallest, round(list_sum(e[1:10]), 6) + 0.0 AS head_sum, len(list_filter(e, lambda x: x > 0))::int AS positives FROM v""")
def scalar_arrays(spark, sf_dir):
    e = F.col("e")
    add = lambda a, x: a + x
    df = S.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return df.select(
        "vec_id", F.size(e).alias("n"), round6(F.element_at(e, 1)).alias("first"), round6(F.array_max(e)).alias("largest"),
        (F.array_position(e, F.array_max(e)) - 1).alias("argmax"),
        round6(F.aggregate(e, F.lit(0.0), add) / F.size(e)).alias("mean"), round6(F.array_sort(e)[0]).alias("smallest"),
        round6(F.aggregate(F.slice(e, 1, 10), F.lit(0.0), add)).alias("head_sum"), F.size(F.filter(e, lambda x: x > 0)).alias("positives"),
    )


@query(f"""WITH {S.PACKETS_SQL} SELECT packet_id, CASE WHEN predicted = truth THEN confidence ELSE 1 - confidence END AS p_truth, CASE WHEN predicted = 'Benign' THEN confidence ELSE 0.0::double END AS p_benign,
  CASE WHEN predicted = truth THEN 1 ELSE 2 END::int AS n_classes, CASE WHEN predicted <= truth THEN predicted ELSE truth END AS first_key FROM packets""")
def scalar_maps(spark, sf_dir):
    same = F.col("predicted") == F.col("truth")
    names = F.when(same, F.array("truth")).otherwise(F.array("truth", "predicted"))
    values = F.when(same, F.array("confidence")).otherwise(F.array(1 - F.col("confidence"), F.col("confidence")))
    df = S.packets(spark, sf_dir).select("packet_id", "truth", F.map_from_arrays(names, values).alias("m"), F.lit("Benign").alias("b"), "predicted", "confidence")
    # The predicted class keeps its confidence; asking for a class not held gives zero.
    benign = F.when(F.col("predicted") == "Benign", F.coalesce(F.try_element_at("m", F.col("b")), F.lit(0.0))).otherwise(0.0)
    return df.select(
        "packet_id", F.element_at("m", F.col("truth")).alias("p_truth"), benign.alias("p_benign"),
        F.size("m").alias("n_classes"), F.array_min(F.map_keys("m")).alias("first_key"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k_text, json_extract_string(props, '$.k')::bigint AS k, json_extract_string(props, '$.missing') AS missing,
  '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS written FROM events""")
def scalar_json(spark, sf_dir):
    parsed = F.from_json("props", "k bigint, other map<string, string>")
    return S.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"), parsed["k"].alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("written"),
    )

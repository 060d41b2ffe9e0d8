"""Queries that explain scores."""

from __future__ import annotations

from math import comb

from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.functions.hashing import hash_word_sql
from flowquarry.functions.labels import CLASSES
from flowquarry.functions.numeric import round6
from flowquarry.operators import anchors as A
from flowquarry.operators import explain as X
from flowquarry.operators import profiles as P
from flowquarry.operators import shapley as K
from flowquarry.operators.cleaning import impact_value
from flowquarry.plans.profiling import IMPORTANCE_SQL, NAMES, SCORED, SCORED_SQL, importance_table
from flowquarry.plans.registry import query
from flowquarry.sources import tables as S
from flowquarry.sources.artifacts import FEATURE_DESCRIPTIONS

WIDE_PHI_SQL = (
    IMPORTANCE_SQL
    + ", wide AS (SELECT flow_id, "
    + ", ".join(f"max(CASE WHEN feature = '{f}' THEN phi END) AS {a}" for f, a in NAMES.items())
    + ", sum(phi) AS total FROM phi GROUP BY flow_id), base AS (SELECT sum(((ma - mb) / s) * ((mb - m) / s)) AS base FROM g JOIN bg USING (feature))"
)


@query(f"""WITH {WIDE_PHI_SQL} SELECT flow_id, {", ".join(f"round({a}, 6) + 0.0 AS {a}" for a in NAMES.values())},
  round(base, 6) + 0.0 AS base, round(base + total, 6) + 0.0 AS final FROM wide, base""")
def linear_shap(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    model = X.fit_linear(df, SCORED)
    return df.select(
        "flow_id",
        *[round6(phi).alias(NAMES[f]) for f, phi in zip(model.features, model.contributions())],
        round6(F.lit(model.base)).alias("base"),
        round6(model.score()).alias("final"),
    )


@query(f"""WITH {WIDE_PHI_SQL} SELECT flow_id, round(base, 6) + 0.0 AS base_value, round(base + total, 6) + 0.0 AS final_value, 4::int AS n_features,
  round(total, 6) + 0.0 AS phi_sum, (SELECT "Rate" FROM flows f WHERE f.flow_id = wide.flow_id) AS first_value FROM wide, base""")
def force_plot(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    record = X.force_record(X.fit_linear(df, SCORED))
    rows = df.select("flow_id", record.alias("r"))
    total = F.aggregate("r.features", F.lit(0.0), lambda acc, e: acc + e["phi"])
    return rows.select(
        "flow_id", round6(F.col("r.base_value")).alias("base_value"), round6(F.col("r.final_value")).alias("final_value"),
        F.size("r.features").alias("n_features"), round6(total).alias("phi_sum"),
        F.col("r.features")[0]["value"].alias("first_value"),
    )


@query(f"WITH {IMPORTANCE_SQL} SELECT flow_id, feature, v AS value, round(phi, 6) + 0.0 AS phi FROM phi")
def attribution_rows(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    rows = X.attribution_rows(df, X.fit_linear(df, SCORED), ["flow_id"])
    return rows.select("flow_id", "feature", "value", round6(F.col("phi")).alias("phi"))


@query(f"""WITH {IMPORTANCE_SQL}, t AS (SELECT flow_id, feature, round(phi, 4) + 0.0 AS contribution,
    row_number() OVER (PARTITION BY flow_id ORDER BY abs(round(phi, 4)) DESC, list_position(['Rate', 'Tot size', 'IAT', 'Variance'], feature))::int AS position FROM phi)
  SELECT flow_id, position, feature, contribution, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS impact,
    abs(contribution) AS impact_value FROM t WHERE position <= 3""")
def top_features(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    rows = df.select("flow_id", F.posexplode(X.top_contributions(X.fit_linear(df, SCORED), 3)).alias("p", "e"))
    contribution = F.col("e.contribution")
    return rows.select(
        "flow_id", (F.col("p") + 1).alias("position"), F.col("e.feature").alias("feature"),
        contribution.alias("contribution"), F.col("e.impact").alias("impact"),
        impact_value(F.lit(None).cast("string"), contribution.cast("string")).alias("impact_value"),
    )


DEVIATION_SQL = (
    IMPORTANCE_SQL
    + """, ben AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS std FROM long WHERE label = 'Benign' GROUP BY feature),
dev AS (SELECT flow_id, feature, v, position, (v - mean) / std AS z, abs(v - mean) / (abs(mean) + 1e-6) AS deviation,
  row_number() OVER (PARTITION BY flow_id ORDER BY abs(v - mean) / (abs(mean) + 1e-6) DESC,
    list_position(['Rate', 'Tot size', 'IAT', 'Variance'], feature)) AS r
  FROM long JOIN ben USING (feature) JOIN ranked_imp USING (feature))"""
)


def _deviating(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    ranks = {r["feature"]: r["position"] for r in importance_table(spark, sf_dir).collect()}
    return X.baseline_deviation(df, X.fit_baseline(df, SCORED, ranks))


@query(f"WITH {DEVIATION_SQL} SELECT flow_id, feature, round(deviation, 6) AS deviation, round(z, 6) + 0.0 AS z, v AS value, position AS rank FROM dev WHERE r = 1")
def baseline_deviation(spark, sf_dir):
    c = F.col("critical")
    return _deviating(spark, sf_dir).select(
        "flow_id", c["feature"].alias("feature"), round6(c["deviation"]).alias("deviation"), round6(c["z"]).alias("z"),
        c["value"].alias("value"), c["rank"].alias("rank"),
    )


@query(f"""WITH {DEVIATION_SQL}, n AS (SELECT *, CASE feature WHEN 'Rate' THEN 'Network Traffic Speed' WHEN 'IAT' THEN 'Time Between Packets'
    WHEN 'Tot size' THEN 'Total Data Volume' ELSE 'Data Variability' END AS name FROM dev WHERE r = 1)
  SELECT flow_id, name || ' son derece ' || CASE WHEN deviation > 5 THEN 'ekstremdir' WHEN deviation > 2 THEN 'yüksektir' ELSE 'düzensizdir' END
    || '. Normal hasta izleme trafiğine kıyasla ' || CASE WHEN deviation > 2 THEN floor(deviation)::bigint ELSE 2 END || 'x kat daha fazladır.' AS plain,
    'Feature ''' || feature || ''' | Rank: #' || position || ' | Z-Score: ' || CASE WHEN z >= 0 THEN '+' ELSE '' END || printf('%.1f', z)
    || ' | Value: ' || round(v::decimal(18, 2), 1)::decimal(18, 1)::varchar AS technical FROM n""")
def dual_explanation(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in FEATURE_DESCRIPTIONS.items() for x in kv])
    texts = X.dual_messages(F.try_element_at(names, F.col("critical.feature")))
    return _deviating(spark, sf_dir).select("flow_id", *[c.alias(n) for n, c in texts.items()])


def _anchor_sql():
    bins = ", ".join(
        f"""least(floor(("{f}" - min("{f}") OVER ()) / (max("{f}") OVER () - min("{f}") OVER ()) * 16), 15)::int AS {a}"""
        for f, a in NAMES.items()
    )
    singles = [f"SELECT '{f}' AS f1, {a} AS b1, NULL AS f2, NULL::int AS b2, predicted FROM b" for f, a in NAMES.items()]
    pairs = [
        f"SELECT '{f}', {NAMES[f]}, '{g}', {NAMES[g]}, predicted FROM b" for i, f in enumerate(SCORED) for g in SCORED[i + 1 :]
    ]
    return f"""WITH {SCORED_SQL}, b AS (SELECT predicted, {bins} FROM flows JOIN scored USING (flow_id)),
  cand AS ({" UNION ALL ".join(singles + pairs)}),
  n AS (SELECT f1, b1, f2, b2, predicted, count(*) AS n FROM cand GROUP BY ALL),
  s AS (SELECT *, sum(n) OVER (PARTITION BY f1, b1, f2, b2) AS c FROM n),
  ok AS (SELECT *, n / c::double AS precision, c / (SELECT count(*) FROM flows)::double AS coverage FROM s WHERE n / c::double >= 0.85)
  SELECT f1, b1, f2, b2, predicted AS label, round(precision, 6) AS precision, round(coverage, 6) AS coverage FROM ok
  WHERE f2 IS NULL OR (NOT EXISTS (SELECT 1 FROM ok o WHERE o.f2 IS NULL AND o.f1 = ok.f1 AND o.b1 = ok.b1)
    AND NOT EXISTS (SELECT 1 FROM ok o WHERE o.f2 IS NULL AND o.f1 = ok.f2 AND o.b1 = ok.b2))"""


@query(_anchor_sql())
def anchor_rules(spark, sf_dir):
    """What the prototypes predict, told by one or two features."""
    flows = S.flows(spark, sf_dir)
    scored = P.fit_prototypes(flows, SCORED).transform(flows).select("predicted", *[quoted(f) for f in SCORED])
    row = flows.agg(*[fn(quoted(f)).alias(f"{n}{i}") for i, f in enumerate(SCORED) for n, fn in (("lo", F.min), ("hi", F.max))]).collect()[0]
    edges = {f: (row[f"lo{i}"], row[f"hi{i}"]) for i, f in enumerate(SCORED)}
    rules = X.anchor_rules(scored, SCORED, edges, "predicted")
    return rules.select("f1", "b1", "f2", "b2", "label", round6(F.col("precision")).alias("precision"), round6(F.col("coverage")).alias("coverage"))


def _background(df):
    row = df.filter("label = 'Benign'").agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(SCORED)]).collect()[0]
    return {f: row[f"m{i}"] for i, f in enumerate(SCORED)}


def _shapley(spark, sf_dir, groups=None):
    df = S.flows(spark, sf_dir)
    model = P.fit_prototypes(df, SCORED)
    phi = X.exact_shapley(df, "flow_id", SCORED, _background(df), lambda rows: 1.0 - model.probability(rows, "Benign"), groups)
    return phi.select("flow_id", "part", round6(F.col("phi")).alias("phi"))


def _shapley_sql(parts):
    """Every coalition of the parts as a column; the background is the Benign prototype."""
    n = len(parts)
    centres = ", ".join(f"max(CASE WHEN c = '{c}' THEN c_{a} END) AS {a}_{c}" for c in CLASSES for a in NAMES.values())

    def score(mask):
        chosen = {a: a if any(mask >> i & 1 and f in g for i, g in enumerate(parts)) else f"{a}_Benign" for f, a in NAMES.items()}
        far = {c: " + ".join(f"({y} - {a}_{c}) ^ 2" for a, y in chosen.items()) for c in CLASSES}
        return f"1 - 1 / ({' + '.join(f'exp(({far["Benign"]}) - ({far[c]}))' for c in CLASSES)}) AS v{mask}"

    rows = []
    for i, g in enumerate(parts):
        rest = [m for m in range(1 << n) if not m >> i & 1]
        phi = " + ".join(f"(v{m | 1 << i} - v{m}) / {n * comb(n - 1, m.bit_count())}" for m in rest)
        rows.append(f"SELECT flow_id, '{'+'.join(g)}' AS part, round({phi}, 6) + 0.0 AS phi FROM v")
    return f"""WITH {SCORED_SQL}, w AS (SELECT {centres} FROM proto),
  v AS (SELECT flow_id, {", ".join(score(m) for m in range(1 << n))} FROM scaled, w) {" UNION ALL ".join(rows)}"""


@query(_shapley_sql([[f] for f in SCORED]))
def sampled_shapley(spark, sf_dir):
    """Four features have sixteen coalitions: all are taken instead of a sample."""
    return _shapley(spark, sf_dir)


VOLUME_AND_TIMING = [["Rate", "Tot size"], ["IAT", "Variance"]]


@query(_shapley_sql(VOLUME_AND_TIMING))
def grouped_shapley(spark, sf_dir):
    """Named groups, as the SQL has them; ``correlated_shapley`` finds the groups in the table."""
    return _shapley(spark, sf_dir, VOLUME_AND_TIMING)


@query()
def correlated_shapley(spark, sf_dir):
    """Groups are the features that move together in the table; the tests hold it against brute force."""
    return _shapley(spark, sf_dir, X.correlated_groups(P.correlations(S.flows(spark, sf_dir), SCORED), SCORED, threshold=0.3))


# --- explainers with a background sample ---------------------------------------------


def _mixed_score_sql(names, chosen):
    """1 - P(Benign) of a row whose ``chosen`` features are its own and the others the background's."""
    point = {a: f"x.{a}" if a in chosen else f"g.{a}" for a in names}
    far = {c: " + ".join(f"({y} - {a}_{c}) ^ 2" for a, y in point.items()) for c in CLASSES}
    return f"avg(1 - 1 / ({' + '.join(f'exp(({far["Benign"]}) - ({far[c]}))' for c in CLASSES)}))"


def _values_sql(names, rows=K.BACKGROUND_ROWS, of="scaled"):
    """Every coalition's mean score over the background as a column, by bits of the features."""
    centres = ", ".join(f"max(CASE WHEN c = '{c}' THEN c_{a} END) AS {a}_{c}" for c in CLASSES for a in names)
    columns = ", ".join(f"{_mixed_score_sql(names, [a for i, a in enumerate(names) if m >> i & 1])} AS v{m}" for m in range(1 << len(names)))
    return f"""w AS (SELECT {centres} FROM proto),
  g AS (SELECT {", ".join(names)} FROM scaled ORDER BY {hash_word_sql("flow_id", 0)}, {hash_word_sql("flow_id", 1)}, flow_id LIMIT {rows}),
  v AS (SELECT flow_id, {columns} FROM {of} x, w, g GROUP BY flow_id)"""


def _kernel_sql(of="scaled", more=""):
    n, names = len(SCORED), list(NAMES.values())
    rows = []
    for i, f in enumerate(SCORED):
        rest = [m for m in range(1 << n) if not m >> i & 1]
        phi = " + ".join(f"(v{m | 1 << i} - v{m}) / {n * comb(n - 1, m.bit_count())}" for m in rest)
        rows.append(f"SELECT flow_id, '{f}' AS part, round({phi}, 6) + 0.0 AS phi FROM v")
    return f"WITH {SCORED_SQL}{more}, {_values_sql(names, of=of)} {' UNION ALL '.join(rows)}"


def _kernel(explained, df):
    model = P.fit_prototypes(df, SCORED)
    background = K.background_rows(df, "flow_id", SCORED)
    phi = K.kernel_shapley(explained(model), "flow_id", SCORED, background, P.OtherClass(model, "Benign"))
    return phi.select("flow_id", "part", round6(F.col("phi")).alias("phi"))


@query(_kernel_sql())
def kernel_shapley(spark, sf_dir):
    """Weighted least squares over coalitions against 50 rows; with four features all coalitions."""
    df = S.flows(spark, sf_dir)
    return _kernel(lambda model: df, df)


@query(
    _kernel_sql(
        "flagged",
        ", flagged AS (SELECT x.* FROM scaled x JOIN scored s USING (flow_id) WHERE s.predicted <> 'Benign' ORDER BY x.ts, x.flow_id LIMIT 1)",
    )
)
def first_flagged(spark, sf_dir):
    """Why the first flow in time that is not predicted Benign was flagged."""
    df = S.flows(spark, sf_dir)
    return _kernel(lambda model: model.transform(df).filter("predicted <> 'Benign'").orderBy("ts", "flow_id").limit(1), df)


#: Two pairs that move together by their making.
PAIRED = {"Rate": '"Rate"', "Tot sum": '"Rate" + 1000 * "Tot size"', "IAT": '"IAT"', "Std": '"IAT" + 0.5 * "Variance"'}
PAIRED_NAMES = {"Rate": "rate", "Tot sum": "tot", "IAT": "iat", "Std": "std"}


def _partition_sql():
    names = list(PAIRED_NAMES.values())
    made = ", ".join(f"{e} AS r_{a}" for e, a in zip(PAIRED.values(), names))
    stats = ", ".join(f"avg(r_{a}) AS m_{a}, stddev_pop(r_{a}) AS s_{a}" for a in names)
    rows = []
    for i, f in enumerate(PAIRED):
        sibling, others = 1 << (i ^ 1), 0b1100 if i < 2 else 0b0011
        contexts = [0, sibling, others, sibling | others]
        phi = " + ".join(f"(v{c | 1 << i} - v{c}) / 4" for c in contexts)
        rows.append(f"SELECT flow_id, '{f}' AS part, round({phi}, 6) + 0.0 AS phi FROM v")
    return f"""WITH {S.FLOWS_SQL}, made AS (SELECT flow_id, label, {made} FROM flows), params AS (SELECT {stats} FROM made),
  scaled AS (SELECT flow_id, label, {", ".join(f"(r_{a} - m_{a}) / s_{a} AS {a}" for a in names)} FROM made, params),
  proto AS (SELECT label AS c, {", ".join(f"avg({a}) AS c_{a}" for a in names)} FROM scaled GROUP BY label),
  {_values_sql(names)} {" UNION ALL ".join(rows)}"""


@query(_partition_sql())
def partition_shapley(spark, sf_dir):
    """Owen values down the tree of the features' correlations, against 50 rows."""
    df = S.flows(spark, sf_dir)
    made = df.select("flow_id", "label", *[F.expr(e.replace('"', "`")).alias(f) for f, e in PAIRED.items()])
    features = list(PAIRED)
    model = P.fit_prototypes(made, features)
    phi = K.partition_shapley(
        made, "flow_id", features, K.background_rows(made, "flow_id", features),
        P.OtherClass(model, "Benign"), P.correlations(made, features),
    )
    return phi.select("flow_id", "part", round6(F.col("phi")).alias("phi"))


# --- anchors by beam search ----------------------------------------------------------

SURE = 0.9


def _beam_sql():
    bins = ", ".join(
        f"""least(floor(("{f}" - min("{f}") OVER ()) / (max("{f}") OVER () - min("{f}") OVER ()) * {A.BINS}), {A.BINS - 1})::int AS {a}"""
        for f, a in NAMES.items()
    )
    long = " UNION ALL ".join(f"SELECT flow_id, predicted, {i} AS f, {i * 100} + {a} AS code FROM b" for i, a in enumerate(NAMES.values()))
    p, off = "(hits / n::double)", f"{A.Z} * sqrt(hits / n::double * (1 - hits / n::double) / n + {A.Z * A.Z} / (4.0 * n * n))"
    steps = []
    for k in range(1, A.ROUNDS + 1):
        grown = (
            "SELECT label, [code] AS rule, flow_id, predicted FROM classes, long"
            if k == 1
            else f"""SELECT DISTINCT m.label, list_sort(list_append(m.rule, l.code)) AS rule, l.flow_id, l.predicted FROM m{k - 1} m JOIN long l USING (flow_id)
              WHERE NOT list_contains(list_transform(m.rule, lambda c: c // 100), l.f)"""
        )
        steps.append(f"""g{k} AS ({grown}), n{k} AS (SELECT label, rule, count(*) AS n, count(*) FILTER (predicted = label) AS hits FROM g{k} GROUP BY ALL),
  r{k} AS (SELECT *, {k} AS round, ({p} + {A.Z * A.Z} / (2 * n) - {off}) / (1 + {A.Z * A.Z} / n) AS lower FROM n{k}),
  o{k} AS (SELECT * FROM r{k} WHERE lower < {SURE} QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(lower, 9) DESC, n DESC, rule) <= {A.BEAM}),
  k{k} AS (SELECT * FROM o{k} UNION ALL SELECT * FROM r{k} WHERE lower >= {SURE}),
  m{k} AS (SELECT g.label, g.rule, g.flow_id FROM g{k} g JOIN o{k} o ON g.label = o.label AND g.rule = o.rule)""")
    names = "[" + ", ".join(f"'{f}'" for f in SCORED) + "]"
    return f"""WITH {SCORED_SQL}, b AS (SELECT flow_id, predicted, {bins} FROM flows JOIN scored USING (flow_id)), long AS ({long}),
  classes AS (SELECT DISTINCT predicted AS label FROM b), {", ".join(steps)}
  SELECT label, round::int AS round, array_to_string(list_transform(rule, lambda c: {names}[c // 100 + 1] || '=' || (c % 100)), ' & ') AS rule, n,
    round(hits / n::double, 6) AS precision, round(lower, 6) + 0.0 AS lower, round(n / (SELECT count(*) FROM b)::double, 6) AS coverage, lower >= {SURE} AS anchor
  FROM ({" UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, A.ROUNDS + 1))})"""


@query(_beam_sql())
def anchor_beam(spark, sf_dir):
    """What the prototypes predict, told by as many predicates as the precision needs, three at most."""
    flows = S.flows(spark, sf_dir)
    scored = P.fit_prototypes(flows, SCORED).transform(flows).select("predicted", *[quoted(f) for f in SCORED])
    row = flows.agg(*[fn(quoted(f)).alias(f"{n}{i}") for i, f in enumerate(SCORED) for n, fn in (("lo", F.min), ("hi", F.max))]).collect()[0]
    edges = {f: (row[f"lo{i}"], row[f"hi{i}"]) for i, f in enumerate(SCORED)}
    rules = A.anchor_beam(scored, SCORED, edges, "predicted", precision=SURE)
    numbers = [round6(F.col(c)).alias(c) for c in ("precision", "lower", "coverage")]
    return rules.select("label", "round", F.concat_ws(" & ", "rule").alias("rule"), "n", *numbers, "anchor")


def _counterfactual_sql(tries=8):
    attacks = [c for c in CLASSES if c != "Benign"]
    names = list(NAMES.values())
    centres = ", ".join(f"max(CASE WHEN c = '{c}' THEN c_{a} END) AS {a}_{c}" for c in CLASSES for a in names)

    def far(point, c):
        return " + ".join(f"({y} - {a}_{c}) ^ 2" for a, y in zip(names, point))

    draws = ", ".join(f"{hash_word_sql('s', i)} / 4294967296::double * 4 - 2 AS m{i}" for i in range(4))
    hit = " AND ".join(f"{far([f'{a} + m{i}' for i, a in enumerate(names)], 'Benign')} < {far([f'{a} + m{i}' for i, a in enumerate(names)], c)}" for c in attacks)
    crossing = ", ".join(
        f"CASE WHEN ({far(names, c)}) <= ({far(names, 'Benign')}) THEN (({far(names, 'Benign')}) - ({far(names, c)})) "
        f"/ (({far([f'{a}_Benign' for a in names], c)}) + ({far(names, 'Benign')}) - ({far(names, c)})) ELSE 0 END"
        for c in attacks
    )
    return f"""WITH {SCORED_SQL}, w AS (SELECT {centres} FROM proto), a AS (SELECT x.*, w.*, predicted FROM scaled x JOIN scored USING (flow_id), w WHERE predicted <> 'Benign'),
  d AS (SELECT *, {draws} FROM (SELECT *, concat_ws(':', flow_id, t, 0) AS s FROM a, range({tries}) r(t))),
  walk AS (SELECT *, at0 + (1 - at0) * {X.OVERSHOOT} AS pos FROM (SELECT *, greatest(0.0, {crossing}) AS at0 FROM a)),
  cand AS (SELECT flow_id, predicted, t::int AS try, sqrt(m0 ^ 2 + m1 ^ 2 + m2 ^ 2 + m3 ^ 2) AS far, m0, m1 FROM d WHERE {hit}
    UNION ALL SELECT flow_id, predicted, -1, pos * sqrt({far(names, 'Benign')}), pos * (rate_Benign - rate), pos * (size_Benign - size) FROM walk),
  best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY far, try) = 1)
  SELECT flow_id, predicted, round(far, 6) + 0.0 AS distance, try, round(f."Rate" + m0 * s_rate, 2) + 0.0 AS rate, round(f."Tot size" + m1 * s_size, 6) + 0.0 AS size
  FROM best JOIN flows f USING (flow_id), params"""


@query(_counterfactual_sql())
def counterfactual_random(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    model = P.fit_prototypes(df, SCORED)
    attacks = model.transform(df).filter("predicted <> 'Benign'")
    found = X.random_counterfactuals(attacks, "flow_id", model)
    c = F.col("counterfactual")
    return found.select(
        "flow_id", "predicted", round6(c["distance"]).alias("distance"), c["try"].alias("try"),
        (F.round(c["Rate"], 2) + F.lit(0.0)).alias("rate"), round6(c["Tot size"]).alias("size"),
    )

"""Registered queries on boosted trees and the scoring job, with the SQL that says the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.functions.labels import CLASSES, SEVERITIES
from flowloom.functions.vectors import argmax
from flowloom.operators import boosting, features as fx, prep, scoring
from flowloom.plans import flow_queries
from flowloom.session import forget, keep, shared_folder, table

#: Rounds that the SQL twin can follow: two, of trees of two levels, on all rows and features.
SHORT = boosting.Settings(rounds=2, depth=2, bins=16, row_share=1.0, column_share=1.0)
EMBEDDED_CLASSES = 10


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.withColumn("held", F.col("vec_id") % 5 == 0)


def _margins(e: DataFrame, model: boosting.Ensemble) -> DataFrame:
    rows = e.select("vec_id", F.posexplode(boosting.margins(model, F.col("embedding"))).alias("class_id", "margin"))
    return rows.withColumn("margin", F.round("margin", 6))


def boosted_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margins of every row by an ensemble of two rounds."""
    e = _embeddings(spark, sf_dir)
    return _margins(e, boosting.train(e, "vec_id", "embedding", "label", EMBEDDED_CLASSES, SHORT))


def boosted_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by one round and, going on from that model, one more."""
    e = _embeddings(spark, sf_dir)
    one = replace(SHORT, rounds=1)
    model = boosting.train(e, "vec_id", "embedding", "label", EMBEDDED_CLASSES, one)
    return _margins(e, boosting.train(e, "vec_id", "embedding", "label", EMBEDDED_CLASSES, one, older=model))


def boosted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained with balanced class weights on rows and early stop by held-out rows, judged on these.
    A level of trees is a job whatever the rows, so rounds, depth and patience are below the defaults."""
    e = prep.weighted(_embeddings(spark, sf_dir), "label")
    model = boosting.train(e, "vec_id", "embedding", "label", EMBEDDED_CLASSES, boosting.Settings(rounds=30, depth=4, bins=63, patience=5), weight="weight", held="held")
    guess = e.where("held").withColumn("class_id", argmax(boosting.margins(model, F.col("embedding"))))
    return prep.report(guess, "label", "class_id")


# --- the scoring job ----------------------------------------------------------


def small_ensemble() -> boosting.Ensemble:
    """Two rounds of trees with three leaves, whose features, cuts and values follow a rule. The
    starts differ by what no two sums of values do, so that no two classes tie."""
    trees = []
    for r in range(2):
        for k in range(len(CLASSES)):
            tree = boosting.Tree()
            left, _ = tree.split(0, (11 * k + 5 * r) % 38, 0, (k - 4) * 0.21 + r * 0.13 + 0.037, (0.0, 0.3 * ((k * 7 + r) % 5) - 0.5))
            tree.split(left, (17 * k + 3 * r + 1) % 38, 0, (3 - k) * 0.17 - r * 0.11 + 0.029, (0.2 * ((k * 3 + r) % 7) - 0.4, 0.25 * ((k + r) % 3)))
            trees.append(tree)
    return boosting.Ensemble(len(CLASSES), [round(0.0537 * k, 4) for k in range(len(CLASSES))], trees)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flow as a queued line (id, flow_json); every twentieth is cut short."""
    line = fx.flow_json()
    made = flow_queries._features(spark, sf_dir).select(F.col("flow").alias("id"), line.alias("flow_json"))
    return made.withColumn("flow_json", F.when(F.col("id") % 20 == 7, F.expr("substr(flow_json, 1, 40)")).otherwise(F.col("flow_json")))


def _parsed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The flows of lines that are whole, with their vectors ("vector"), kept: fitting and scoring
    read them, so packets become lines, and these vectors, once."""
    lines = _lines(spark, sf_dir).withColumn("value", F.col("flow_json"))
    flows = scoring.parse_flow_lines(lines, keep=["id"], all_lines=True).where("malformed is null").drop("malformed")
    made = flows.withColumn("vector", scoring.vector_of(flows, tuple(fx.FEATURES)))
    return keep(made.select(*columns, "vector") if columns else made, "parsed")


def _bundle(flows: DataFrame) -> scoring.Bundle:
    """A bundle whose scaler is fitted to the flows: a row for each feature comes to the driver."""
    names = tuple(fx.FEATURES)
    rows = prep.moments(flows.select(F.col("vector") if "vector" in flows.columns else scoring.vector_of(flows, names).alias("vector")), "vector").orderBy("place").collect()
    zeros = [0.0] * len(names)
    return scoring.Bundle(small_ensemble(), [r["mean"] for r in rows] or zeros, [r["std"] for r in rows] or zeros, names, version="rule")


def score_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flow's line parsed, its 38 features scaled and judged by a small fixed ensemble."""
    flows = _parsed(spark, sf_dir, "flow_id")
    folder = shared_folder(spark, "bundle")
    bundle = scoring.Bundle.load(spark, _bundle(flows).save(spark, folder))
    out = scoring.score(flows, bundle, "vector")
    return out.select("flow_id", "class_id", "is_malicious", "attack_type", "severity", F.round("confidence", 3).alias("confidence"), F.size("probabilities").alias("n"))


def scoring_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue taken in three batches, the second of which fails after the upsert and is tried
    again: what became of each line."""
    folder = shared_folder(spark, "scoring")
    _lines(spark, sf_dir).write.parquet(f"{folder}/lines")
    lines = spark.read.schema("id long, flow_json string").parquet(f"{folder}/lines")
    flows = scoring.parse_flow_lines(lines.withColumn("value", F.col("flow_json")))
    job = scoring.ScoringJob(folder, _bundle(flows.where("malformed is null")), buckets=8)
    for batch in range(3):
        part = lines.where(F.col("id") % 3 == batch)
        if batch == 1:
            job.store(part, batch)
        job.take(part, batch)
    found = job.flows.read(spark).select("seq", "flow_id").join(job.detections.read(spark).select("flow_id", "class_id", "severity"), "flow_id")
    bad = job.poison(spark).select("id", F.lit(True).alias("poison"))
    out = job.processed(spark).join(found.withColumnRenamed("seq", "id"), "id", "left").join(bad, "id", "left")
    return out.select("id", "flow_id", "class_id", "severity", F.coalesce("poison", F.lit(False)).alias("poison"))


def detection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored flows as JSON lines, read again: what a consumer of the records sees."""
    flows = _parsed(spark, sf_dir)
    folder = shared_folder(spark, "detections")
    scoring.detection_lines(scoring.score(flows, _bundle(flows), "vector").drop("vector")).write.text(folder)
    forget(flows)
    read = F.from_json("value", "flow_id string, detection struct<is_malicious:boolean,class_id:int,attack_type:string,probabilities:map<string,double>>")
    rows = spark.read.text(folder).select(read.alias("j")).select("j.flow_id", "j.detection.*")
    sure = F.round(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b), 2)
    return rows.select("flow_id", "is_malicious", "class_id", "attack_type", sure.alias("sum_probabilities"))


# --- SQL ----------------------------------------------------------------------


def _boosting_sql(s: boosting.Settings) -> str:
    """Training and margins, unrolled: a few common tables for each round and level."""
    k_all = EMBEDDED_CLASSES
    score = lambda g, h: f"pow(greatest(abs({g}) - {s.l1}, 0), 2) / ({h} + {s.l2})"
    value = lambda g, h: f"-{s.rate} * sign({g}) * greatest(abs({g}) - {s.l1}, 0) / ({h} + {s.l2})"
    text = f"""with places as (select vec_id, label, unnest(range(len(embedding)))::int as place, unnest(embedding)::double as x from embeddings),
cuts as (select place, list_sort(list_distinct(quantile_disc(x, [{", ".join(str(i / s.bins) for i in range(1, s.bins))}]))) as c from places group by place),
binned as materialized (select vec_id, place, len(list_filter(c, lambda y: y < x)) as b from places join cuts using (place)),
classes as (select unnest(range({k_all}))::int as k),
m_0 as (select vec_id, label, k, ln(greatest((select count(*) from embeddings e where e.label = k)::double / (select count(*) from embeddings), 1e-15)) as margin from embeddings, classes)"""
    for r in range(s.rounds):
        text += f""",
p_{r} as (select *, exp(margin - max(margin) over (partition by vec_id)) as e from m_{r}),
s_{r} as (select *, e / sum(e) over (partition by vec_id) as p from p_{r}),
n_{r}_0 as materialized (select vec_id, label, k, margin, p - (label = k)::int as g, {k_all / (k_all - 1)!r}::double * p * (1 - p) as h, 0 as node, 0.0::double as v, true as open from s_{r})"""
        for d in range(s.depth):
            text += f""",
h_{r}_{d} as (select k, node, place, b, sum(g) as g, sum(h) as h, count(*) as n from n_{r}_{d} join binned using (vec_id) where open group by all),
c_{r}_{d} as (select k, node, place, b, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over a as ga, sum(h) over a as ha, sum(n) over a as na
  from h_{r}_{d} window w as (partition by k, node, place order by b), a as (partition by k, node, place)),
q_{r}_{d} as (select *, round({score("gl", "hl")} + {score("(ga - gl)", "(ha - hl)")} - {score("ga", "ha")}, 9) as gain from c_{r}_{d}
  where least(nl, na - nl) >= {s.least_rows} and least(hl, ha - hl) >= {s.least_curvature}),
b_{r}_{d} as (select * from q_{r}_{d} where gain > 0 qualify row_number() over (partition by k, node order by gain desc, place, b) = 1),
n_{r}_{d + 1} as materialized (
  select t.vec_id, label, t.k, margin, g, h, case when s.k is null then t.node when i.b <= s.b then 2 * t.node + 1 else 2 * t.node + 2 end as node,
    case when s.k is null then v when i.b <= s.b then {value("gl", "hl")} else {value("(ga - gl)", "(ha - hl)")} end as v,
    s.k is not null and case when i.b <= s.b then nl else na - nl end >= {2 * s.least_rows} as open
  from n_{r}_{d} t left join b_{r}_{d} s on t.k = s.k and t.node = s.node and t.open left join binned i on i.vec_id = t.vec_id and i.place = s.place)"""
        text += f""",
m_{r + 1} as (select vec_id, label, k, margin + v as margin from n_{r}_{s.depth})"""
    return text + f" select vec_id, k as class_id, round(margin, 6) as margin from m_{s.rounds}"


def _tree_sql(tree: boosting.Tree, node: int = 0) -> str:
    if tree.feature[node] < 0:
        return f"{tree.value[node]!r}::double"
    return f"case when v[{tree.feature[node] + 1}] <= {tree.cut[node]!r}::double then {_tree_sql(tree, tree.left[node])} else {_tree_sql(tree, tree.right[node])} end"


def _score_sql() -> str:
    model = small_ensemble()
    decimals = {c: 2 if c in ("flow_duration", "total_tcp_flow_time") else 4 for c in fx.FEATURES}
    sums = [" + ".join([f"{model.base[k]!r}::double", *[_tree_sql(t) for t in model.trees[k :: model.classes]]]) for k in range(model.classes)]
    labels = "labels_of(id, name, severity) as (values " + ", ".join(f"({i}, '{c}', '{SEVERITIES[c]}')" for i, c in enumerate(CLASSES)) + ")"
    moments = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}" for c in fx.FEATURES)
    scaled = ", ".join(f"({c} - m_{c}) / case when d_{c} = 0 then 1 else d_{c} end" for c in fx.FEATURES)
    return f"""with {flow_queries.EXACT}, {flow_queries.FEATURES}, {labels},
good as (select flow, flow_id, {", ".join(f"printf('%.{decimals[c]}f', {c}::double)::double::float::double as {c}" for c in fx.FEATURES)} from feats where flow % 20 <> 7),
moments as (select {moments} from good),
vectors as (select flow, flow_id, [{scaled}] as v from good, moments),
margins as (select flow, flow_id, [{", ".join(sums)}] as m from vectors),
probs as (select flow, flow_id, list_transform(m, lambda x: exp(x - list_max(m))) as e from margins),
scored as (select flow, flow_id, e, (list_position(e, list_max(e)) - 1)::int as class_id from probs)"""


_SCORES = _score_sql()

ORACLES = {
    "boosted_margins": _boosting_sql(SHORT),
    "boosted_continued": _boosting_sql(SHORT),
    "score_flows": f"{_SCORES} select flow_id, class_id, (class_id <> 0)::int as is_malicious, name as attack_type, severity, round(round(list_max(e) / list_sum(e), 4), 3) as confidence, {len(CLASSES)} as n from scored join labels_of on id = class_id",
    "scoring_job": f"{_SCORES} select f.flow as id, s.flow_id, s.class_id, l.severity, f.flow % 20 = 7 as poison from feats f left join scored s on s.flow = f.flow left join labels_of l on l.id = s.class_id",
    "detection_records": f"{_SCORES} select flow_id, class_id <> 0 as is_malicious, class_id, name as attack_type, 1.0::double as sum_probabilities from scored join labels_of on id = class_id",
}

QUERIES = {f.__name__: f for f in (boosted_margins, boosted_continued, boosted_report, score_flows, scoring_job, detection_records)}

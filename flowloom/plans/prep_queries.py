"""Registered queries on scoring and dataset preparation, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flowloom.functions.labels import CLASSES, SEVERITIES, class_label, severity
from flowloom.functions.vectors import argmax, feature_vector, softmax
from flowloom.operators import prep
from flowloom.session import table

#: Names of the vector that the JSON query asks for; the lines spell them otherwise.
ASKED = ["Flow Duration", "Fwd IAT Mean", "FIN Flag Count", "Flow Bytes/s", "Not There"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training table: a label, and a value that is at times infinite, NaN or null."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(k == 7, "Web Attack - XSS").when(k == 8, "Infiltration - NMAP Portscan").when(k == 9, "Attempted-relabel-as-Benign").when(F.col("event_type") == "click", "Benign").otherwise(F.col("event_type"))
    b = F.col("event_id") % 20
    x = F.when(b == 0, float("inf")).when(b == 1, float("-inf")).when(b == 2, float("nan")).when(b == 3, F.lit(None)).otherwise(F.col("value"))
    return e.select("event_id", "user_id", k.alias("k"), label.alias("label"), x.cast("double").alias("x"), "event_type")


def json_normalize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature maps in JSON with mixed spellings and bad values, as vectors."""
    e = _labelled(spark, sf_dir)
    odd = F.element_at(F.array(*map(F.lit, ("null", '"abc"', "true", '"1.5"', '"NaN"', '"Infinity"'))), (F.col("k") % 6 + 1).cast("int"))
    inner = F.concat(F.lit('{"flow_duration": '), F.col("k").cast("string"), F.lit(', "FWD-IAT mean": "'), (F.col("user_id") % 97).cast("string"), F.lit('", "fin_flag_count": '), odd, F.lit(', "Flow Bytes/s": 7, "flow_bytes_s": 8}'))
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"features": '), inner, F.lit("}"))).otherwise(inner)
    nested = F.from_json(F.get_json_object("line", "$.features"), "map<string,string>")
    flat = F.from_json("line", "map<string,string>")
    v = e.select("event_id", line.alias("line")).select("event_id", feature_vector(nested, ASKED, flat).alias("v"))
    return v.select("event_id", *[F.get("v", i).cast("double").alias(f"v{i}") for i in range(len(ASKED))])


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nine places of each embedding as scores of the classes."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", softmax(F.slice(F.col("embedding").cast("array<double>"), 1, 9)).alias("p"))


def score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probabilities(spark, sf_dir).withColumn("class_id", argmax(F.col("p")))
    return p.select("vec_id", "class_id", F.round(F.array_max("p"), 4).alias("confidence"))


def score_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection records, with the severity by the table and by an empty one."""
    p = _probabilities(spark, sf_dir).withColumn("class_id", argmax(F.col("p")))
    label = class_label(F.col("class_id"))
    by_label = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.transform("p", lambda x: F.round(x, 4)))
    return p.select("vec_id", label.alias("attack_type"), (F.col("class_id") != 0).alias("is_malicious"), severity(label, F.col("class_id")).alias("severity"), severity(label, F.col("class_id"), {}).alias("bare_severity"), F.element_at(by_label, "DoS Hulk").alias("p_hulk"))


def scale_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = prep.standardise(table(spark, sf_dir, "embeddings"), "embedding")
    return e.select("vec_id", F.posexplode("scaled").alias("place", "z")).select("vec_id", "place", F.round("z", 4).alias("z"))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.encode_labels(_labelled(spark, sf_dir), "label").select("event_id", "label", "label_id")


def label_distribution_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _labelled(spark, sf_dir).withColumn("label", prep.relabel(F.col("label")))
    return prep.distribution(e, "label")


def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the classes that training leaves out, by pattern and by list."""
    e = _labelled(spark, sf_dir)
    return e.where(~F.col("label").ilike("%web attack%") & ~F.col("label").ilike("%infiltration%") & ~F.col("label").isin("error", "signup")).select("event_id", "label")


def undersample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.undersample(_labelled(spark, sf_dir), "label", "event_id", {"Benign": 0.3, "view": 0.5}).select("event_id", "label")


def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split(_labelled(spark, sf_dir), "event_id").groupBy("part", "label").agg(F.count("*").alias("n"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 40 events of each user and label, then at most 1000 of each label."""
    order = [prep.bucket(F.col("event_id"), 1_000_003), F.col("event_id")]
    one = prep.sample_strata(_labelled(spark, sf_dir), ["user_id", "label"], order, 40)
    return prep.sample_strata(one.drop("place"), ["label"], order, 1000).select("event_id", "label", "place")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_split(_labelled(spark, sf_dir), "label", "event_id").select("event_id", "label", "part")


def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _labelled(spark, sf_dir).select((F.col("k") % 10).alias("k"), "label", F.when(F.isnan("x"), F.col("x")).alias("x"))
    return prep.distinct_rows(e)


def clean_inf_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = prep.infinite_to_null(_labelled(spark, sf_dir).select("event_id", "x"), nan_too=False)
    return prep.null_to_zero(e, ["x"]).select("event_id", F.isnan("x").alias("is_nan"), F.when(~F.isnan("x"), F.col("x")).alias("x"))


def drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = prep.infinite_to_null(_labelled(spark, sf_dir)).select("event_id", "label", "x", F.when(F.col("event_id") % 3 == 0, F.col("x")).alias("y"))
    return prep.drop_empty_rows(e, ["x", "y"]).select("event_id")


def downcast_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow types, without identifiers and strings but the label, missing columns as 0."""
    e = prep.drop_identifiers(prep.narrow(_labelled(spark, sf_dir)), {"user_id"}, "label")
    return prep.with_missing(e, ["event_id", "label", "k", "absent"])


def cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _labelled(spark, sf_dir)
    return prep.cleaning_stats(e, prep.drop_empty_rows(prep.infinite_to_null(e), ["x"]), "event_type")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a constant place, a linear copy and a near copy at the end."""
    v = F.col("embedding").cast("array<double>")
    more = F.array(F.lit(1.0), F.get(v, 0) * 2 + 1, F.get(v, 1) + F.get(v, 2) * 0.01)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(v, more).alias("v"))


def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = prep.moments(_wide(spark, sf_dir), "v")
    return m.select("place", F.round("variance", 6).alias("variance"), (F.col("variance") > 1e-6).alias("kept"))


def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    kept = [r["place"] for r in prep.moments(wide, "v").where("variance > 1e-6").orderBy("place").collect()]
    gone = prep.correlated(wide, "v", kept)
    return spark.createDataFrame([(p, p in gone) for p in kept], "place int, dropped boolean")


def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.anova(table(spark, sf_dir, "embeddings"), "embedding", "label").select("place", F.round("f", 4).alias("f"))


def mi_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.mutual_information(table(spark, sf_dir, "embeddings"), "embedding", "label").select("place", F.round("mi", 4).alias("mi"))


def median_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.above_median(anova_f(spark, sf_dir), "f")


def topk_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anova_f(spark, sf_dir).orderBy(F.desc("f"), "place").limit(20)


def feature_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, and difference, of the features that two methods choose."""
    a = median_cut(spark, sf_dir).agg(F.collect_set("place").alias("a"))
    b = prep.above_median(mi_binned(spark, sf_dir), "mi").agg(F.collect_set("place").alias("b"))
    both = a.join(b, F.lit(True))  # two rows of one feature list each
    name = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select(name(F.array_union("a", "b")).alias("either"), name(F.array_except("a", "b")).alias("only_anova"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.class_weights(table(spark, sf_dir, "embeddings"), "label").select("label", "n", F.round("weight", 4).alias("weight"))


def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").select("quality", "toxic", "n", F.round("share", 4).alias("share"))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = prep.report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return r.select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a scoring session: flows, malicious ones and those of each attack."""
    p = _probabilities(spark, sf_dir).withColumn("class_id", argmax(F.col("p")))
    return p.groupBy(class_label(F.col("class_id")).alias("attack_type")).agg(F.count("*").alias("n"), F.count_if(F.col("class_id") != 0).alias("malicious"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of each log that are not blank: a conversation stands for a log."""
    c = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return c.withColumn("from_end", last).where("from_end <= 2").select("conv_id", "turn", "from_end")


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names made safe, and numbers drawn from names by pattern."""
    p = table(spark, sf_dir, "part")
    safe = F.regexp_replace("p_name", r"[^\p{L}\p{N}_-]", "")
    return p.select("p_partkey", F.when(safe == "", "model").otherwise(safe).alias("safe_name"), F.regexp_extract("p_brand", r"(\d+)$", 1).alias("number"))


def sql_parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL on files: two columns are read, and the filter goes to the scan."""
    return spark.sql(f"""
        SELECT event_type, count(*) AS n, max(value) AS most
        FROM parquet.`{sf_dir}/events.parquet` WHERE value > 10 AND event_type <> 'view' GROUP BY event_type""")


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels counted over several files of one kind, with the file that each is from."""
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.regexp_extract("_metadata.file_path", r"/([a-z]+)\.parquet", 1).alias("file"))
    return parts.groupBy("file", "event_type").agg(F.count("*").alias("n"))


_LABELLED = """
labelled as (
  select event_id, user_id, k, event_type,
         case when k = 7 then 'Web Attack - XSS' when k = 8 then 'Infiltration - NMAP Portscan' when k = 9 then 'Attempted-relabel-as-Benign'
              when event_type = 'click' then 'Benign' else event_type end as label,
         case event_id % 20 when 0 then 'inf'::double when 1 then '-inf'::double when 2 then 'nan'::double when 3 then null else value end as x
  from (select *, regexp_extract(props, '"k": *([0-9]+)', 1)::int as k from events))"""
_L = f"with {_LABELLED.lstrip()}"
_LONG = "places as (select vec_id, label, unnest(range(len(embedding)))::int as place, unnest(embedding)::double as x from embeddings)"
_SCORES = """
scores as (select vec_id, list_transform(embedding[1:9], lambda x: x::double) as s from embeddings),
exps as (select vec_id, s, list_transform(s, lambda x: exp(x - list_max(s))) as e from scores),
probs as (select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from exps),
best as (select vec_id, p, list_position(p, list_max(p)) - 1 as class_id from probs)"""
_NAMES = "labels_of(id, name, severity) as (values " + ", ".join(f"({i}, '{c}', '{SEVERITIES[c]}')" for i, c in enumerate(CLASSES)) + ")"
_ANOVA = f"""{_LONG},
groups as (select place, label, count(*) as n, sum(x) as s, sum(x * x) as q from places group by all),
sums as (select place, sum(n) as n, count(*) as k, sum(s) as s, sum(q) as q, sum(s * s / n) as b from groups group by place),
anova as (select place, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) as f from sums)"""
_MI = """
spans as (select place, min(x) as lo, max(x) as hi from places group by place),
cells as (select place, least(floor((x - lo) / (hi - lo) * 8), 7) as bin, label, count(*) as n from places join spans using (place) group by all),
shares as (select *, sum(n) over (partition by place, bin) as of_bin, sum(n) over (partition by place, label) as of_label, sum(n) over (partition by place) as total from cells),
mi as (select place, round(sum(n / total * ln(n * total / (of_bin * of_label))), 4) as mi from shares group by place)"""
_WIDE = """
wide as (select vec_id, list_concat(list_transform(embedding, lambda x: x::double), [1.0::double, embedding[1]::double * 2 + 1, embedding[2]::double + embedding[3]::double * 0.01]) as v from embeddings),
flat as (select vec_id, unnest(range(len(v)))::int as place, unnest(v) as x from wide),
kept as (select place from flat group by place having var_pop(x) > 1e-6)"""

ORACLES = {
    "json_normalize_features": f"{_L} select event_id, k::double as v0, (user_id % 97)::double as v1, case k % 6 when 2 then 1.0 when 3 then 1.5 else 0.0 end::double as v2, 8.0::double as v3, 0.0::double as v4 from labelled",
    "score_argmax": f"with {_SCORES.lstrip()} select vec_id, class_id::int as class_id, round(list_max(p), 4) as confidence from best",
    "score_severity": f"with {_NAMES}, {_SCORES.lstrip()} select vec_id, name as attack_type, class_id <> 0 as is_malicious, severity, case when class_id <> 0 then 'HIGH' else 'INFO' end as bare_severity, round(p[7], 4) as p_hulk from best join labels_of on id = class_id",
    "scale_vector": f"with {_LONG}, m as (select place, avg(x) as mean, stddev_pop(x) as std from places group by place) select vec_id, place, round((x - mean) / case when std = 0 then 1 else std end, 4) as z from places join m using (place)",
    "label_encode": f"{_L}, ids as (select label, row_number() over (order by label <> 'Benign', label) - 1 as label_id from (select distinct label from labelled)) select event_id, label, label_id::int as label_id from labelled join ids using (label)",
    "label_distribution_pct": f"{_L}, r as (select case when label = 'Attempted-relabel-as-Benign' then 'Benign' else label end as label from labelled) select label, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 2) as pct from r group by label",
    "label_filter": f"{_L} select event_id, label from labelled where label not ilike '%web attack%' and label not ilike '%infiltration%' and label not in ('error', 'signup')",
    "undersample_hash": f"{_L} select event_id, label from labelled where (event_id * 7919) % 1000 < case label when 'Benign' then 300 when 'view' then 500 else 1000 end",
    "split_hash": f"{_L} select case when (event_id * 7919) % 1000 < 700 then 'train' when (event_id * 7919) % 1000 < 850 then 'validation' else 'test' end as part, label, count(*) as n from labelled group by all",
    "stratified_sample": f"""{_L}, h as (select *, (event_id * 7919) % 1000003 as h from labelled),
one as (select * from (select *, row_number() over (partition by user_id, label order by h, event_id) as r from h) where r <= 40)
select event_id, label, place::int as place from (select event_id, label, row_number() over (partition by label order by h, event_id) as place from one) where place <= 1000""",
    "stratified_split": f"{_L}, r as (select event_id, label, row_number() over (partition by label order by (event_id * 7919) % 1000003, event_id) as r, count(*) over (partition by label) as n from labelled) select event_id, label, case when r <= floor(n * 0.8::double) then 'train' else 'validation' end as part from r",
    "dedupe_rows": f"{_L} select distinct k % 10 as k, label, null::double as x from labelled",
    "clean_inf_nan": f"{_L} select event_id, coalesce(isnan(x), false) as is_nan, case when isinf(x) or x is null then 0 when not isnan(x) then x end as x from labelled",
    "drop_all_null": f"{_L} select event_id from labelled where isfinite(x)",
    "downcast_select": f"{_L} select event_id::int as event_id, label, k, 0.0::double as absent from labelled",
    "cleaning_stats": f"{_L} select event_type, count(*) as original_rows, count(*) filter (isfinite(x)) as final_rows, count(*) - count(*) filter (isfinite(x)) as removed_rows from labelled group by event_type",
    "variance_filter": f"with {_WIDE.lstrip()} select place, round(var_pop(x), 6) as variance, var_pop(x) > 1e-6 as kept from flat group by place",
    "corr_prune": f"with {_WIDE.lstrip()}, f as (select * from flat semi join kept using (place)), c as (select b.place, max(abs(r)) as r from (select a.place as i, b.place, corr(a.x, b.x) as r from f a join f b on a.vec_id = b.vec_id and a.place < b.place group by all) b group by b.place) select place, coalesce(r > 0.95, false) as dropped from kept left join c using (place)",
    "anova_f": f"with {_ANOVA} select place, f from anova",
    "mi_binned": f"with {_LONG}, {_MI.lstrip()} select place, mi from mi",
    "median_cut": f"with {_ANOVA} select place, f from anova where f > (select quantile_cont(f, 0.5) from anova)",
    "topk_importance": f"with {_ANOVA} select place, f from anova order by f desc, place limit 20",
    "feature_set_ops": f"""with {_ANOVA}, {_MI.lstrip()}, a as (select place from anova where f > (select quantile_cont(f, 0.5) from anova)), b as (select place from mi where mi > (select quantile_cont(mi, 0.5) from mi))
select (select string_agg(place::varchar, ',' order by place) from (select place from a union select place from b)) as either, coalesce((select string_agg(place::varchar, ',' order by place) from (select place from a except select place from b)), '') as only_anova""",
    "class_weights": "select label, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 4) as weight from embeddings group by label",
    "confusion_normalized": "select quality, toxic, n, round(n / sum(n) over (partition by quality), 4) as share from (select quality, toxic, count(*) as n from labels group by all)",
    "classification_report": """
with c as (select quality as t, toxic as p, count(*) as n from labels group by all),
classes as (select t as class from c union select p from c),
one as (select class, coalesce((select sum(n) from c where t = class), 0) as support, coalesce((select sum(n) from c where t = class and p = class), 0) as hits, coalesce((select sum(n) from c where p = class), 0) as guesses from classes),
two as (select *, case when guesses > 0 then hits / guesses else 0 end as precision, case when support > 0 then hits / support else 0 end as recall from one),
three as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from two)
select class::varchar as class, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1, support::bigint as support from three
union all select 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::bigint from three
union all select 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), sum(support)::bigint from three
union all select 'accuracy', round(sum(hits) / sum(support), 4), round(sum(hits) / sum(support), 4), round(sum(hits) / sum(support), 4), sum(support)::bigint from three""",
    "session_counters": f"with {_NAMES}, {_SCORES.lstrip()} select name as attack_type, count(*) as n, count(*) filter (class_id <> 0) as malicious from best join labels_of on id = class_id group by name",
    "log_tail": "select conv_id, turn, from_end::int as from_end from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as from_end from conversations where trim(text) <> '') where from_end <= 2",
    "sql_parquet_scan": "select event_type, count(*) as n, max(value) as most from events where value > 10 and event_type <> 'view' group by event_type",
    "file_counts": "select 'events' as file, event_type, count(*) as n from events group by event_type",
    "name_rules": "select p_partkey, case when regexp_replace(p_name, '[^\\pL\\pN_-]', '', 'g') = '' then 'model' else regexp_replace(p_name, '[^\\pL\\pN_-]', '', 'g') end as safe_name, regexp_extract(p_brand, '([0-9]+)$', 1) as number from part",
}

QUERIES = {name: globals()[name] for name in ORACLES}

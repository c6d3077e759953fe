"""URL filtering by pattern rules that are indexed by their rarest literal token.

All of it is DataFrame code. A rule is a host and a path prefix; its regular expressions say
that the host or a subdomain of it is meant and that the path begins so. A rule's literal
tokens are those bounded on both sides, so that they are whole tokens of every URL that
fits: the labels of its host, and the path's words but a last one that the prefix may cut.
Its index token is the one that is in the fewest URLs. The index is a table of tokens and
rules. Tokens of the distinct URLs fetch their candidate rules from it in a join, and only
these rules' expressions run on the URL; the longest rule that fits decides. Spark
broadcasts the index where its size allows and shuffles both sides else, so that there may
be any number of rules.

Null URLs and those without ``://`` have an empty host and path and get the default
verdict. Of equally long rules the one that sorts last wins; a rule given twice counts once.
Rows that repeat are each judged; an empty table stays empty, and without rules all get the
default verdict. A long URL is taken whole. Other columns stay; those called host, path,
rule or verdict, but the URL itself, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.batches import quoted

#: The rules of the registered query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """The host (A-Z in lower case) and the path of a URL, empty where there is none."""
    text = F.coalesce(F.col(quoted(url)), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def _marked(mark: str, words: Column) -> Column:
    return F.transform(words, lambda x: F.concat(F.lit(mark), x))


def tokens_of(host: Column, path: Column) -> Column:
    """A URL's tokens: host labels are marked h:, path words p:."""
    return F.array_distinct(F.concat(_marked("h:", F.split(host, r"\.")), _marked("p:", F.split(path, r"[^A-Za-z0-9]+"))))


def rule_table(df: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path, name, tokens) of each rule once, from (verdict, host, path)."""
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    whole = F.expr(r"regexp_extract_all(path, '[A-Za-z0-9]+(?=[^A-Za-z0-9])', 0)")
    tokens = F.array_distinct(F.concat(_marked("h:", F.split("host", r"\.")), _marked("p:", whole)))
    return rules.select("verdict", "host", "path").distinct().withColumns({"name": F.concat("host", "path"), "tokens": tokens})


def index_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, verdict, host, path, name): each rule under its token that is in the fewest ``urls``."""
    each = rules.select("verdict", "host", "path", "name", F.explode("tokens").alias("token"))
    asked = each.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"]
    return each.join(counts, "token", "left").groupBy("verdict", "host", "path", "name").agg(rarest.alias("token"))


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def judge_urls(df: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (null if none fits) and verdict."""
    host, path = split_url(url)
    gone = {"host", "path", "rule", "verdict"}
    kept = [F.col(quoted(c)) for c in df.columns if c.lower() not in gone or c == url]
    asked = df.select(F.col(quoted(url)).alias("__url")).where("__url is not null").distinct()
    own, rest = split_url("__url")
    urls = asked.select("__url", own.alias("u_host"), rest.alias("u_path")).withColumn("tokens", tokens_of(F.col("u_host"), F.col("u_path")))
    index = index_of(urls, rule_table(df, rules))
    fetched = urls.select("__url", "u_host", "u_path", F.explode("tokens").alias("token")).join(index, "token")
    fits = F.rlike("u_host", F.concat(F.lit(r"(?s)\A(?:.*\.)?"), _literal(F.col("host")), F.lit(r"\z"))) & F.rlike("u_path", F.concat(F.lit(r"\A"), _literal(F.col("path"))))
    best = fetched.where(fits).groupBy("__url").agg(F.max(F.struct(F.length("name").alias("size"), "name", "verdict")).alias("__best"))
    out = df.select(*kept, host.alias("host"), path.alias("path"), F.col(quoted(url)).alias("__asked"))
    joined = out.join(best, F.col("__asked") == F.col("__url"), "left")
    return joined.select(*[F.col(quoted(c)) for c in out.columns if c != "__asked"], F.col("__best.name").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


#: The same verdicts in plain SQL, without an index.
ORACLE = """
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path
  from pages),
rules(verdict, rhost, rpath) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits as (
  select page_id, verdict, rhost || rpath as rule,
         row_number() over (partition by page_id order by length(rhost || rpath) desc, rhost || rpath desc) as place
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on p.page_id = f.page_id and f.place = 1
"""

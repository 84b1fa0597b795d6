"""op2_url_filters: host, path, rule and verdict of every page."""

from keyloft.llm.common import table
from keyloft.llm.urls import judge

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filters(spark, sf_dir):
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"select * from values {values} as t(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_filters": op2_url_filters}

_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = {
    "op2_url_filters": f"""
with rules(r_host, r_path, r_verdict) as (values {_VALUES}),
parts as (
  select page_id, url,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         row_number() over () as row_id
  from parts),
fits as (
  select row_id, arg_max(r_host || r_path, length(r_host || r_path)) as rule,
         arg_max(r_verdict, length(r_host || r_path)) as verdict
  from split join rules
    on (host = r_host or suffix(host, '.' || r_host)) and starts_with(path, r_path)
  group by row_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from split left join fits using (row_id)"""
}

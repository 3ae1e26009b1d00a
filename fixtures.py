"""Input tables for the registered queries, derived from the test tables.

Each fixture is one SELECT used by both engines. Two tokens differ: ``TEXT`` is
the engine's text type, and ``STAMP`` the ledger's time column, which Spark
keeps as the stored timestamp so that year filters reach the scan.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")

# (schema suffix, condition on the supplier) and (suffix, table, condition)
_SCHEMAS = [
    ("__ingested", "true"),
    ("__claims__standardized", "s_suppkey % 5 <> 0"),
    ("__claims__shared", "s_suppkey % 3 <> 0"),
    ("__physician__shared", "s_suppkey % 7 = 0"),
]
_TABLES = [
    ("__ingested", "835__history", "s_suppkey % 2 = 0 or s_suppkey % 3 = 0"),
    ("__ingested", "837__history", "s_suppkey % 2 = 1"),
    ("__ingested", "eligibility__history", "true"),
    (
        "__claims__standardized",
        "835__remittance__history",
        "s_suppkey % 5 <> 0 and s_suppkey % 2 = 0",
    ),
    (
        "__claims__standardized",
        "835__id_crosswalk",
        "s_suppkey % 5 <> 0 and s_suppkey % 4 = 0",
    ),
    ("__claims__standardized", "crosswalk_b_835", "s_suppkey % 5 <> 0 and s_suppkey % 12 = 0"),
    (
        "__claims__standardized",
        "837__id_crosswalk",
        "s_suppkey % 5 <> 0 and s_suppkey % 2 = 1 and s_suppkey % 9 <> 0",
    ),
    ("__claims__shared", "claims", "s_suppkey % 3 <> 0 and s_suppkey % 8 <> 0"),
    ("__physician__shared", "visits", "s_suppkey % 7 = 0"),
]


def _listing(rules: list[tuple[str, ...]], spark: bool) -> str:
    """Catalog rows per supplier: one exploding scan for Spark, a union otherwise."""
    columns = ("schema_name", "table_name")[: len(rules[0]) - 1]

    def values(rule: tuple[str, ...]) -> str:
        schema = f"'tp' || cast(s_suppkey as TEXT) || '{rule[0]}'"
        named = zip((schema, *[f"'{t}'" for t in rule[1:-1]]), columns)
        return ", ".join(f"{v} as {c}" for v, c in named)

    if not spark:
        return "\nunion all ".join(f"select {values(r)} from supplier where {r[-1]}" for r in rules)
    items = ",\n  ".join(f"case when {r[-1]} then struct({values(r)}) end" for r in rules)
    return f"select inline(array_compact(array(\n  {items}))) from supplier"


FIXTURES = {
    "contributions": """
select d.filer, d.filer_id,
       substr(o.o_orderpriority, 1, 1) as contributor_code,
       d.contributor_first, d.contributor_last, d.contributor_city,
       case when o.o_orderkey % 50 = 0 then null
            else cast(o.o_totalprice as decimal(18,2)) end as amount,
       cast(null as TEXT) as memo
from orders o
join (
  select c.c_mktsegment as filer, c.c_custkey as filer_id,
         case when c.c_custkey % 4 = 0 then null
              when c.c_custkey % 4 = 1 then ''
              else 'F' || cast(c.c_custkey % 50 as TEXT) end as contributor_first,
         case when c.c_custkey % 4 in (0, 1) or c.c_custkey % 40 = 2 then p.p_name
              else 'surname' || cast(c.c_custkey % 200 as TEXT) end as contributor_last,
         case when c.c_custkey % 97 = 0 then null
              when c.c_custkey % 2 = 0 then n.n_name
              else lower(n.n_name) end as contributor_city
  from customer c
  join nation n on c.c_nationkey = n.n_nationkey
  join (select p_partkey, p_name from part) p on p.p_partkey = c.c_custkey % 200
) d on o.o_custkey = d.filer_id
""",
    "acquisition": """
select case when o_orderkey % 11 = 0 then 'TP_B_x' else 'TP_A' end as trading_partner,
       case when o_orderkey % 4 = 0 then '837_inst' else '835_rem' end as data_feed,
       '/landing/' || o_orderpriority || '/f' || cast(o_orderkey as TEXT)
         || case when o_orderkey % 3 = 0 then '.txt.bz2' else '.txt' end as file_path,
       STAMP as src_last_modified
from orders
""",
    "layer_ingested": """
select 'raw/' || cast(l_linenumber as TEXT) || '/f' || cast(l_orderkey as TEXT)
         || case when l_linenumber % 2 = 0 then '.txt.bz2' else '.txt' end as meta_lineage_source_name
from lineitem
""",
    "layer_standardized": """
select * from layer_ingested where meta_lineage_source_name not like '%7.txt%'
""",
    "layer_shared": """
select meta_lineage_source_name as FileName
from layer_standardized where meta_lineage_source_name not like '%/f1%'
""",
    "crosswalk_rows": """
select t.schema_name, t.table_name,
       case when s.s_suppkey % 8 = 0 then null
            when s.s_suppkey % 8 = 1 then '  '
            when s.s_suppkey % 8 = 3 then 'NaN'
            when t.table_name like 'crosswalk%' then ''
            else 'A' || cast(s.s_suppkey as TEXT) end as account_number
from catalog_tables t
join supplier s on split_part(t.schema_name, '__', 1) = 'tp' || cast(s.s_suppkey as TEXT)
where t.table_name like '%crosswalk%'
""",
    "survey": """
select c.c_custkey as row_id, cast(18 + c.c_custkey % 48 as int) as age, r.r_name as country,
       c.c_mktsegment as job_role, cast(coalesce(o.n_orders, 0) as int) as experience_years,
       cast(c.c_custkey * 31 % 40 as int) as remote_hours,
       cast(1 + c.c_custkey * 17 % 10 as int) as job_satisfaction,
       cast(c.c_custkey * 13 % 7 as int) as tech_tools,
       case when c.c_custkey % 3 = 0 then 'small' when c.c_custkey % 3 = 1 then 'medium' else 'large' end as company_size,
       c.c_acctbal as salary,
       case when 6 * (1 + c.c_custkey * 17 % 10) + c.c_custkey * 31 % 40
                 + c.c_custkey * 7919 % 101 > 130 then 1 else 0 end as preference
from customer c
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
left join (select o_custkey, count(*) as n_orders from orders group by o_custkey) o
  on o.o_custkey = c.c_custkey
""",
    "document_quality": """
select d.doc_id, cast(d.n_chars as double) as n_chars, d.lang, d.source, l.quality
from labels l join documents d on d.doc_id = l.doc_id
""",
}

_NEEDS = {
    "layer_standardized": ("layer_ingested",),
    "layer_shared": ("layer_ingested", "layer_standardized"),
    "crosswalk_rows": ("catalog_tables",),
}


def _text(name: str, spark: bool) -> str:
    if name == "catalog_schemas":
        body = _listing(_SCHEMAS, spark)
    elif name == "catalog_tables":
        body = _listing(_TABLES, spark)
    else:
        body = FIXTURES[name]
    stamp = "o_orderdate" if spark else "cast(o_orderdate as varchar)"
    return body.replace("TEXT", "string" if spark else "varchar").replace("STAMP", stamp).strip()


def ctes(names: tuple[str, ...], spark: bool = False) -> str:
    """``name as (select ...)`` for fixtures and whatever they build on."""
    ordered: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    return ",\n".join(f"{n} as (\n{_text(n, spark)}\n)" for n in ordered)


@lru_cache(maxsize=64)
def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a Spark frame over the parquet tables."""
    used: set[str] = set()

    def placed(m: re.Match) -> str:
        used.add(m[2])
        return f"{m[1]} {{{m[2]}}}"

    body = f"with {ctes((name,), spark=True)}\nselect * from {name}"
    body = re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", placed, body)
    return spark.sql(body, **{t: _table(spark, f"{sf_dir}/{t}.parquet") for t in used})

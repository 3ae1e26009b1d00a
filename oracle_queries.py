"""The registered queries as plain SQL, for an independent check."""

from __future__ import annotations

import re

from fixtures import ctes
from ledgerloom.plans.onboarding import (
    MISSING_TYPE,
    NO_SHARED,
    NO_STANDARDIZED,
    TYPES_DIFFER,
    TYPES_MATCH,
)


def _q(fixtures: str | tuple[str, ...], body: str, recursive: bool = False) -> str:
    names = (fixtures,) if isinstance(fixtures, str) else fixtures
    return f"with {'recursive ' if recursive else ''}{ctes(names)}{body}"


_YEARS = "('1996', '1997', '1998', '1999', '2000')"


def _acquired(length: int, partner: str, feed: str) -> str:
    return _q(
        "acquisition",
        f"""
select substr(src_last_modified, 1, {length}) as period, count(distinct file_path) as unique_file_paths
from acquisition
where trading_partner like '%{partner}%' and data_feed like '%{feed}%'
  and substr(src_last_modified, 1, 4) in {_YEARS}
group by 1
""",
    )


def _layer(table: str, column: str, length: int) -> str:
    return _q(
        ("acquisition", table),
        f"""
select substr(a.src_last_modified, 1, {length}) as period, count(distinct l.name) as unique_file_paths
from (
  select src_last_modified,
         case when right(file_path, 4) = '.bz2' then split_part(split_part(file_path, '/', -1), '.bz2', 1)
              else split_part(file_path, '/', -1) end as k
  from acquisition
  where trading_partner like '%TP_A%' and data_feed like '%835%'
) a
join (select split_part({column}, '/', -1) as name from {table}) l
  on a.k = replace(l.name, '.bz2', '')
group by 1
""",
    )


def _coverage(length: int) -> str:
    layers = {
        "ingested": ("layer_ingested", "meta_lineage_source_name"),
        "standardized": ("layer_standardized", "meta_lineage_source_name"),
        "shared": ("layer_shared", "FileName"),
    }
    keys = ",\n".join(
        f"k_{n} as (select distinct replace(split_part({c}, '/', -1), '.bz2', '') as k from {t})"
        for n, (t, c) in layers.items()
    )
    counts = ", ".join(f"count(k_{n}.k) as {n}_files" for n in layers)
    shares = ", ".join(
        f"round(count(k_{n}.k) / cast(count(*) as double), 6) as {n}_coverage" for n in layers
    )
    joins = " ".join(f"left join k_{n} on k_{n}.k = a.k" for n in layers)
    return _q(
        ("acquisition", *[t for t, _ in layers.values()]),
        f""",
{keys},
a as (select distinct substr(src_last_modified, 1, {length}) as period,
             replace(split_part(file_path, '/', -1), '.bz2', '') as k from acquisition)
select a.period, count(*) as acquired_files, {counts}, {shares}
from a {joins} group by a.period
""",
    )


# --- onboarding -------------------------------------------------------------

_TYPED = """,
typed as (
  select schema_name, table_name,
         case when table_name like '%835%' then '835' else '837' end as type_code,
         split_part(schema_name, '__', 1) as base_schema,
         lower(schema_name) like '%ingested%' as is_ingested,
         lower(schema_name) like '%standardized%' as is_standardized,
         regexp_matches(table_name, '(835|837).*crosswalk|crosswalk.*(835|837)') as is_crosswalk
  from catalog_tables where table_name like '%835%' or table_name like '%837%'
)"""

_LINKS = (
    _TYPED
    + """,
populated as (
  select schema_name, table_name,
         max(case when trim(account_number) <> '' and lower(trim(account_number)) <> 'nan' then 1 else 0 end) as hit
  from crosswalk_rows group by 1, 2
),
links as (
  select distinct t.schema_name, t.type_code, case when coalesce(p.hit, 0) = 1 then 'True' else 'False' end as linked
  from typed t left join populated p on p.schema_name = t.schema_name and p.table_name = t.table_name
  where t.is_standardized and t.is_crosswalk
)"""
)

# the joins with their full fan-out, then distinct lines, as the steps are told
_STATUS = (
    _LINKS
    + """,
ing as (select distinct base_schema, type_code as type_ingested from typed where is_ingested),
shr as (
  select s.schema_name, split_part(s.schema_name, '__', 1) as base_schema,
         case when exists (select 1 from catalog_tables t where t.schema_name = s.schema_name)
              then 'True' else 'False' end as shared_completed
  from catalog_schemas s where s.schema_name like '%shared%'
),
std as (
  select split_part(l.schema_name, '__', 1) as base_schema, l.type_code, l.linked
  from links l join typed t on t.schema_name = l.schema_name and t.type_code = l.type_code and t.is_standardized
),
std_schemas as (
  select distinct trim(regexp_replace(schema_name, '^__|__.*$', '', 'g')) as partner
  from catalog_schemas where schema_name like '%standardized%'
),
joined as (
  select i.base_schema, i.type_ingested, coalesce(h.shared_completed, '@NO_SHARED@') as shared_completed,
         h.schema_name as shared_schema, d.type_code as type_standardized, coalesce(d.linked, 'False') as linked
  from ing i left join shr h on h.base_schema = i.base_schema
  left join std d on d.base_schema = i.base_schema
),
labelled as (
  select base_schema as partner, type_ingested, shared_completed, shared_schema, linked,
         case when type_standardized is null and base_schema not in (select partner from std_schemas)
                then '@NO_STANDARDIZED@'
              when exists (select 1 from std s where s.base_schema = j.base_schema and s.type_code = j.type_ingested)
                then 'True'
              else 'Table ' || type_ingested || ' @MISSING_TYPE@' end as standardized_completed
  from joined j
),
lines as (
  select partner, type_ingested, standardized_completed, shared_completed, linked, min(shared_schema) as first_shared
  from labelled group by 1, 2, 3, 4, 5
),
ranked as (
  select *, max(case when linked = 'False' then 1 else 0 end) over (partition by partner, type_ingested) as any_false,
         row_number() over (partition by partner, type_ingested
                            order by first_shared nulls first, shared_completed, linked) as rn
  from lines
),
status as (
  select partner as trading_partner_id, type_ingested as table_type_ingested, standardized_completed,
         case when standardized_completed like '%@MISSING_TYPE@%' then 'False'
              else shared_completed end as shared_completed,
         case when standardized_completed like '%@MISSING_TYPE@%' then 'False'
              else linked end as account_linking_completed
  from ranked where (any_false = 1 and linked = 'False') or (any_false = 0 and rn = 1)
)"""
)

_CATALOG = ("catalog_schemas", "catalog_tables", "crosswalk_rows")


def _status(body: str) -> str:
    return _q(_CATALOG, _STATUS + body)


# --- contributions ----------------------------------------------------------

_A = """,
rows_a as (select * from contributions where filer in ('BUILDING', 'MACHINERY'))"""
_B = """,
rows_b as (select * from contributions where filer in ('AUTOMOBILE', 'FURNITURE'))"""
_ORGS = (
    _A
    + """,
orgs as (
  select contributor_last, coalesce(sum(amount), 0) as total_amount from rows_a
  where (contributor_first is null or contributor_first = '') and contributor_last is not null
  group by 1
),
everyone as (
  select contributor_last, coalesce(sum(amount), 0) as total_amount from rows_a
  where contributor_last is not null group by 1
),
people as (
  select e.* from everyone e
  where not exists (select 1 from orgs o where o.contributor_last = e.contributor_last)
),
industries as (
  select case when lower(contributor_last) like '%plate%' then 'Plates'
              when lower(contributor_last) like '%widget%' or lower(contributor_last) like '%red%' then 'Goods'
              else 'Other' end as category, sum(total_amount) as total_amount
  from orgs group by 1
),
bins as (
  select case when total_amount >= 6000000 then 'Large' when total_amount >= 3000000 then 'Medium'
              else 'Small' end as category, count(*) as n_keys, sum(total_amount) as total_amount
  from people group by 1
)"""
)

_PCT = (
    "round(100 * cast(total_amount as double) / cast(sum(total_amount) over () as double), 1) as pct"
)
_MONEY = "cast(total_amount as double) as total_amount"


def _contrib(body: str, base: str = _ORGS) -> str:
    return _q("contributions", base + body)


def _places(rows: str, key: str, fold: bool) -> str:
    def name(n: int) -> str:
        return f"'nation_{n}'" if fold else f"'NATION_{n}'"

    near = ", ".join(name(n) for n in range(1, 9))
    return f""",
cities as (
  select {key} as city, coalesce(sum(amount), 0) as amount from {rows}
  where contributor_city is not null group by 1
),
classes as (
  select case when city = {name(0)} then 'Home' when city in ({near}) then 'Near' else 'Other' end as category,
         sum(amount) as total_amount
  from cities group by 1
)
select category, {_MONEY}, {_PCT} from classes
"""


# --- survey -----------------------------------------------------------------

_SCORES = """,
scored as (
  select row_id, preference as actual,
         1 / (1 + exp(-(-7.5 + 0.9 * job_satisfaction + 0.12 * remote_hours - 0.01 * age
              + 0.25 * (case when company_size = 'small' then 1.0::double else 0 end)
              - 0.4 * (case when country = 'ASIA' then 1.0::double else 0 end))::double)) as p_full,
         1 / (1 + exp(-(-6.0 + 0.7 * job_satisfaction + 0.1 * remote_hours)::double)) as p_short,
         1 / (1 + exp(-(-9.0 + 0.01 * tech_tools)::double)) as p_never
  from survey
)"""

_METRICS = (
    _SCORES
    + """,
classes as (
  select 'full' as model, p_full >= 0.3 as c, actual from scored
  union all select 'short', p_short >= 0.3, actual from scored
  union all select 'never', p_never >= 0.3, actual from scored
),
cells as (
  select model,
         count(*) filter (where c and actual = 1) as tp, count(*) filter (where c and actual = 0) as fp,
         count(*) filter (where not c and actual = 1) as fn, count(*) filter (where not c and actual = 0) as tn
  from classes group by model
),
rates as (
  select *, (tp + tn) / cast(tp + tn + fp + fn as double) as accuracy,
         tp / cast(nullif(tp + fp, 0) as double) as precision,
         tp / cast(nullif(tp + fn, 0) as double) as recall
  from cells
)"""
)

# Newton's method for intercept and two slopes: each recursion step is one
# aggregate over the survey and a three by three solve by cofactors. The slopes
# carry a penalty per row, given by its gradient Q1, Q2 and curvature P11, P12,
# P22. The two signals are positive, which makes every penalty smooth here.
_NEWTON = """,
fit(i, b0, b1, b2, c00, c11, c22) as (
  select 0, 0::double, START::double, START::double, 0::double, 0::double, 0::double
  union all
  select i + 1, b0 + (k00 * g0 + k01 * g1 + k02 * g2) / det, b1 + (k01 * g0 + k11 * g1 + k12 * g2) / det,
         b2 + (k02 * g0 + k12 * g1 + k22 * g2) / det, k00 / det, k11 / det, k22 / det
  from (
    select *, h00 * k00 + h01 * k01 + h02 * k02 as det
    from (
      select *, h11 * h22 - h12 * h12 as k00, h02 * h12 - h01 * h22 as k01, h01 * h12 - h02 * h11 as k02,
             h00 * h22 - h02 * h02 as k11, h01 * h02 - h00 * h12 as k12, h00 * h11 - h01 * h01 as k22
      from (
        select i, b0, b1, b2, sum(w) as h00, sum(w * x1) as h01, sum(w * x2) as h02,
               sum(w * x1 * x1 + P11) as h11, sum(w * x1 * x2 + P12) as h12, sum(w * x2 * x2 + P22) as h22,
               sum(y - p) as g0, sum((y - p) * x1 - Q1) as g1, sum((y - p) * x2 - Q2) as g2
        from (
          select *, p * (1 - p) as w
          from (
            select f.i, f.b0, f.b1, f.b2, d.x1, d.x2, d.y,
                   1 / (1 + exp(-(f.b0 + f.b1 * d.x1 + f.b2 * d.x2))) as p
            from fit f, data d where f.i < 20
          )
        ) group by i, b0, b1, b2
      )
    )
  )
),
final as (select * from fit where i = 20)"""
_TWO = """,
data as (
  select cast(preference as double) as y, cast(job_satisfaction as double) as x1,
         cast(remote_hours as double) as x2 from survey
)"""
_DEVIANCES = """,
deviances as (
  select (select -2 * sum(y * ln(r) + (1 - y) * ln(1 - r)) from data, (select avg(y) as r from data)) as null_dev,
         (select -2 * sum(y * ln(p) + (1 - y) * ln(1 - p))
          from (select y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) as p from data, final)) as dev,
         (select count(*) from data) as n
)"""
_SCALED = """,
stats as (
  select avg(job_satisfaction) as m1, stddev_pop(job_satisfaction) as s1,
         avg(remote_hours) as m2, stddev_pop(remote_hours) as s2 from survey
),
data as (
  select cast(preference as double) as y, (job_satisfaction - m1) / s1 as x1, (remote_hours - m2) / s2 as x2
  from survey, stats
)"""


_FREE = ("0", "0", "0", "0", "0")


def _fit(body: str, data: str = _TWO, penalty: tuple[str, ...] = _FREE, start: str = "0") -> str:
    newton = _NEWTON.replace("START", start)
    for mark, text in zip(("Q1", "Q2", "P11", "P12", "P22"), penalty):
        newton = newton.replace(mark, f"({text})")
    return _q("survey", data + newton + body, recursive=True)


def _deviance_of(tag: str, x1: str, x2: str) -> str:
    """Newton's fit on up to two columns as CTEs with a tag; a column given as 0
    gets a curvature of its own, which keeps its slope at 0."""
    penalty = ["0", "0", "0", "0", "0"]
    for i, x in enumerate((x1, x2)):
        if x == "0":
            penalty[i], penalty[2 * i + 2] = f"b{i + 1}", "1"
    newton = _NEWTON.replace("START", "0")
    for mark, text in zip(("Q1", "Q2", "P11", "P12", "P22"), penalty):
        newton = newton.replace(mark, f"({text})")
    for name in ("fit(", "from fit ", "data d", "final as"):
        newton = newton.replace(name, re.sub(r"^(from )?(fit|data|final)", rf"\1\2_{tag}", name))
    return f""",
data_{tag} as (
  select cast(preference as double) as y, cast({x1} as double) as x1, cast({x2} as double) as x2 from survey
){newton},
dev_{tag} as (
  select -2 * sum(y * ln(p) + (1 - y) * ln(1 - p)) as dev
  from (select y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) as p from data_{tag}, final_{tag})
)"""


_FOUR_FITS = (
    _deviance_of("none", "0", "0")
    + _deviance_of("one", "job_satisfaction", "0")
    + _deviance_of("two", "0", "remote_hours")
    + _deviance_of("both", "job_satisfaction", "remote_hours")
)
_STEP_ROWS = """
select step, action, term, k as n_coefficients, round(dev, 4) as deviance, round(dev + 2 * k, 4) as aic,
       round(dev + k * ln((select count(*) from survey)), 4) as bic
from steps
"""
_STEPS_BACK = (
    _FOUR_FITS
    + """,
first as (
  select * from (select 'remote_hours' as term, 'job_satisfaction' as other, dev from dev_one
                 union all select 'job_satisfaction', 'remote_hours', dev from dev_two)
  order by dev limit 1
),
steps as (
  select 0 as step, 'start' as action, '' as term, 3 as k, dev from dev_both
  union all
  select 1, 'drop', f.term, 2, f.dev from first f, dev_both b where f.dev + 4 < b.dev + 6
  union all
  select 2, 'drop', f.other, 1, n.dev from first f, dev_none n, dev_both b
  where f.dev + 4 < b.dev + 6 and n.dev + 2 < f.dev + 4
)"""
    + _STEP_ROWS
)
_STEPS = (
    _FOUR_FITS
    + """,
first as (
  select * from (select 'job_satisfaction' as term, 'remote_hours' as other, dev from dev_one
                 union all select 'remote_hours', 'job_satisfaction', dev from dev_two)
  order by dev limit 1
),
steps as (
  select 0 as step, 'start' as action, '' as term, 1 as k, dev from dev_none
  union all
  select 1, 'add', f.term, 2, f.dev from first f, dev_none n where f.dev + 4 < n.dev + 2
  union all
  select 2, 'add', f.other, 3, b.dev from first f, dev_none n, dev_both b
  where f.dev + 4 < n.dev + 2 and b.dev + 6 < f.dev + 4
)"""
    + _STEP_ROWS
)


def _elastic(lam: float, alpha: float) -> str:
    """Coefficients at one penalty on scaled columns, given back unscaled."""
    l1, l2 = f"{lam * alpha}::double", f"{lam * (1 - alpha)}::double"
    return _fit(
        f"""
select {lam}::double as lambda, '(Intercept)' as term, round(b0 - b1 * m1 / s1 - b2 * m2 / s2, 4) as coefficient
from final, stats
union all select {lam}, 'job_satisfaction', round(b1 / s1, 4) from final, stats
union all select {lam}, 'remote_hours', round(b2 / s2, 4) from final, stats
""",
        _SCALED,
        (f"{l1} + {l2} * b1", f"{l1} + {l2} * b2", l2, "0", l2),
    )


_R = "sqrt(b1 * b1 + b2 * b2)"
_W = "0.02 * sqrt(2)"
_GROUP = (
    f"{_W} * b1 / {_R}",
    f"{_W} * b2 / {_R}",
    f"{_W} * (1 / {_R} - b1 * b1 / power({_R}, 3))",
    f"-{_W} * b1 * b2 / power({_R}, 3)",
    f"{_W} * (1 / {_R} - b2 * b2 / power({_R}, 3))",
)


ORACLE: dict[str, str] = {
    "acq_files_by_month": _acquired(7, "TP", "835"),
    "acq_files_by_year": _acquired(4, "TP_B", ""),
    "layer_coverage_by_year": _coverage(4),
    "layer_coverage_by_month": _coverage(7),
    "catalog_typed_inventory": _q("catalog_tables", _TYPED + "\nselect * from typed"),
    "ingested_feed_types": _q(
        "catalog_tables",
        _TYPED + "\nselect distinct base_schema, type_code as type_ingested from typed where is_ingested",
    ),
    "account_link_status": _q(
        _CATALOG,
        _LINKS
        + """
select l.schema_name, l.type_code, l.linked, t.table_name
from links l join typed t on t.schema_name = l.schema_name and t.type_code = l.type_code
where t.is_standardized
""",
    ),
    "schema_has_tables": _q(
        ("catalog_schemas", "catalog_tables"),
        """
select s.schema_name, count(t.table_name) > 0 as has_tables,
       split_part(s.schema_name, '__', 1) as base_schema,
       trim(regexp_replace(s.schema_name, '^__|__.*$', '', 'g')) as standard_base
from catalog_schemas s left join catalog_tables t on t.schema_name = s.schema_name
where s.schema_name like '%shared%' or s.schema_name like '%standardized%'
group by s.schema_name
""",
    ),
    "onboarding_type_labels": _q(
        _CATALOG,
        _LINKS
        + """,
ing as (select distinct base_schema, type_code as type_ingested from typed where is_ingested),
std as (select distinct split_part(schema_name, '__', 1) as base_schema, type_code as type_standardized from links)
select i.base_schema, i.type_ingested,
       coalesce(s.type_standardized, '@NO_STANDARDIZED@') as type_standardized,
       case when i.type_ingested = s.type_standardized then '@TYPES_MATCH@'
            else '@TYPES_DIFFER@' end as type_label
from ing i left join std s on s.base_schema = i.base_schema
""",
    ),
    "onboarding_status": _status("\nselect * from status"),
    "onboarding_funnel": _status(
        """,
keys as (select distinct trading_partner_id, table_type_ingested from status where account_linking_completed = 'True')
select s.table_type_ingested, count(s.trading_partner_id) as ingested,
       count(*) filter (where s.standardized_completed <> 'True') as ingested_only,
       count(*) filter (where s.standardized_completed = 'True') as standardized,
       count(*) filter (where s.shared_completed = 'True' and k.trading_partner_id is null) as shared_not_linked,
       count(*) filter (where s.account_linking_completed = 'True') as fully_linked
from status s left join keys k on k.trading_partner_id = s.trading_partner_id
  and k.table_type_ingested = s.table_type_ingested
group by 1
"""
    ),
    "shared_not_linked": _status(
        """
select s.trading_partner_id, s.table_type_ingested, s.shared_completed from status s
where s.shared_completed = 'True' and not exists (
  select 1 from status k where k.trading_partner_id = s.trading_partner_id
    and k.table_type_ingested = s.table_type_ingested and k.account_linking_completed = 'True')
"""
    ),
    "linked_by_type": _status(
        """
select table_type_ingested, count(*) as total_linked from status
where account_linking_completed = 'True' group by 1
"""
    ),
    "contrib_by_code": _contrib(
        """
select coalesce(contributor_code, '') as "ContributorCode", count(*) as n_rows,
       cast(coalesce(sum(amount), 0) as double) as total_amount
from rows_a group by 1 order by 1 limit 5
""",
        _A,
    ),
    "contrib_org_columns": _contrib(
        ",\norg_rows as (select * from rows_a where contributor_first is null or contributor_first = '')\n"
        + "\nunion all\n".join(
            f"select '{c}' as column_name, count({c}) as n_values from org_rows"
            for c in (
                "filer", "filer_id", "contributor_code", "contributor_first", "contributor_last",
                "contributor_city", "amount", "memo",
            )
        ),
        _A,
    ),
    "contrib_org_totals": _contrib(f"\nselect contributor_last, {_MONEY} from orgs"),
    "contrib_by_contributor": _contrib(f"\nselect contributor_last, {_MONEY} from everyone"),
    "contrib_individuals": _contrib(f"\nselect contributor_last, {_MONEY} from people"),
    "contrib_individuals_anti": _contrib(f"\nselect contributor_last, {_MONEY} from people"),
    "contrib_industry_share": _contrib(f"\nselect category, {_MONEY}, {_PCT} from industries"),
    "contrib_size_bins": _contrib(f"\nselect category, n_keys, {_MONEY}, {_PCT} from bins"),
    "contrib_city_totals": _contrib(
        """
select contributor_city, cast(coalesce(sum(amount), 0) as double) as total_amount
from rows_a where contributor_city is not null group by 1
""",
        _A,
    ),
    "contrib_city_class": _contrib(_places("rows_a", "contributor_city", False), _A),
    "contrib_city_class_normalized": _contrib(_places("rows_b", "lower(contributor_city)", True), _B),
    "contrib_cohort_totals": _q(
        "contributions",
        f""",
sums as (
  select case when filer in ('BUILDING', 'MACHINERY') then 'Received by cohort A'
              else 'Received by cohort B' end as cohort, sum(amount) as total_amount
  from contributions where filer in ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE') group by 1
)
select cohort, {_MONEY}, {_PCT} from sums
""",
    ),
    "pref_share_overall": _q(
        "survey",
        """
select country, preference, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share
from survey group by country, preference
""",
    ),
    "pref_share_within": _q(
        "survey",
        """
select job_role, preference, count(*) as n,
       round(count(*) / cast(sum(count(*)) over (partition by job_role) as double), 6) as share
from survey group by job_role, preference
""",
    ),
    "pref_subset_stats": _q(
        "survey",
        """
select round(100.0 * count(*) filter (where preference = 1) / cast(count(*) as double), 6) as percent,
       round(avg(age) filter (where preference = 1), 6) as mean,
       round(stddev_samp(age) filter (where preference = 1), 6) as sd
from survey where job_role = 'BUILDING'
""",
    ),
    "pref_percent": _q(
        "survey",
        """
select round(100.0 * count(*) filter (where preference = 1) / cast(count(*) as double), 6) as percent
from survey where country = 'ASIA'
""",
    ),
    "satisfied_hours_mean_sd": _q(
        "survey",
        """
select round(avg(remote_hours), 6) as mean, round(stddev_samp(remote_hours), 6) as sd
from survey where job_satisfaction >= 8
""",
    ),
    "train_test_split_sizes": _q(
        "survey",
        """
select 'test' as part, cast(floor(0.2 * count(*)) as bigint) as n_rows from survey
union all select 'train', count(*) - cast(floor(0.2 * count(*)) as bigint) from survey
""",
    ),
    "train_test_repeated_ids": _q(
        "survey",
        """
select 'test' as part, cast(floor(0.2 * count(*)) as bigint) as n_rows from survey
union all select 'train', count(*) - cast(floor(0.2 * count(*)) as bigint) from survey
""",
    ),
    "survey_row_numbers": _q(
        "survey",
        "\nselect row_id, age, row_number() over (order by age, row_id) as row_number from survey",
    ),
    "score_given_model": _q(
        "survey",
        _SCORES
        + '\nselect row_id, actual, round(p_full, 6) as "full", round(p_short, 6) as short,'
        + " round(p_never, 6) as never from scored",
    ),
    "mean_probability": _q(
        "survey",
        _SCORES
        + """
select 'full' as model, round(avg(p_full), 6) as avg_probability from scored
union all select 'short', round(avg(p_short), 6) from scored
union all select 'never', round(avg(p_never), 6) from scored
""",
    ),
    "classify_last_ten": _q(
        "survey",
        _SCORES
        + '\nselect row_id, actual, cast(p_full >= 0.3 as int) as "full", cast(p_short >= 0.3 as int) as short,'
        + " cast(p_never >= 0.3 as int) as never from scored order by row_id desc limit 10",
    ),
    "classification_metrics": _q(
        "survey",
        _METRICS
        + """
select model, tp, fp, fn, tn, round(accuracy, 6) as accuracy, round(precision, 6) as precision,
       round(recall, 6) as recall,
       round(2 * precision * recall / nullif(precision + recall, 0), 6) as f1
from rates
""",
    ),
    "best_recall_model": _q(
        "survey",
        _METRICS + "\nselect model, round(recall, 6) as recall from rates order by rates.recall desc nulls last, model limit 1",
    ),
    "glm_two_predictors": _fit(
        """
select '(Intercept)' as term, round(b0, 4) as estimate, round(sqrt(c00), 4) as std_error,
       round(b0 / sqrt(c00), 4) as z_value from final
union all select 'job_satisfaction', round(b1, 4), round(sqrt(c11), 4), round(b1 / sqrt(c11), 4) from final
union all select 'remote_hours', round(b2, 4), round(sqrt(c22), 4), round(b2 / sqrt(c22), 4) from final
"""
    ),
    "glm_odds_two": _fit(
        """
select term, round(exp(b), 4) as odds_ratio, round(100 * (exp(b) - 1), 4) as percent_change
from (select '(Intercept)' as term, b0 as b from final
      union all select 'job_satisfaction', b1 from final
      union all select 'remote_hours', b2 from final)
"""
    ),
    # p < 0.01 for a normal z: its absolute value is over the quantile
    "glm_significant_two": _fit(
        """
select term, round(z, 4) as z_value
from (select '(Intercept)' as term, b0 / sqrt(c00) as z from final
      union all select 'job_satisfaction', b1 / sqrt(c11) from final
      union all select 'remote_hours', b2 / sqrt(c22) from final)
where abs(z) > 2.5758293035489004
"""
    ),
    "glm_two_designs": _fit(
        """
select '(Intercept)' as term, round(b0, 4) as by_formula, round(b0, 4) as by_matrix from final
union all select 'job_satisfaction', round(b1, 4), round(b1, 4) from final
union all select 'remote_hours', round(b2, 4), round(b2, 4) from final
"""
    ),
    "glm_deviance": _fit(
        _DEVIANCES
        + """
select 'null' as model, round(null_dev, 4) as deviance, n - 1 as df from deviances
union all select 'residual', round(dev, 4), n - 3 from deviances
"""
    ),
    "glm_criteria": _fit(
        _DEVIANCES
        + """
select 'two predictors' as model, 3 as n_coefficients, round(dev, 4) as deviance, round(dev + 6, 4) as aic,
       round(dev + 3 * ln(n), 4) as bic from deviances
"""
    ),
    "lrt_null_vs_two": _fit(
        _DEVIANCES
        + """
select round(null_dev - dev, 4) as statistic, 2 as df, round(exp(-(null_dev - dev) / 2), 4) as p_value
from deviances
"""
    ),
    "ridge_fixed_penalty": _elastic(0.1, 0.0),
    "lasso_fixed_penalty": _elastic(0.02, 1.0),
    "enet_fixed_penalty": _elastic(0.02, 0.5),
    "group_lasso_fixed_penalty": _fit(
        """
select 0.02::double as lambda, '(Intercept)' as term, round(b0, 4) as coefficient from final
union all select 0.02, 'job_satisfaction', round(b1, 4) from final
union all select 0.02, 'remote_hours', round(b2, 4) from final
""",
        penalty=_GROUP,
        start="0.01",
    ),
    "lasso_penalty_grid": _q(
        "survey",
        """,
cov as (
  select greatest(abs(covar_pop(age, preference) / stddev_pop(age)),
                  abs(covar_pop(salary, preference) / stddev_pop(salary)),
                  abs(covar_pop(job_satisfaction, preference) / stddev_pop(job_satisfaction)),
                  abs(covar_pop(remote_hours, preference) / stddev_pop(remote_hours))) as top
  from survey
)
select i as step, round(top * power(0.0001, i / 99.0), 6) as lambda from cov, range(100) t(i)
""",
    ),
}
_COMBINED = f"""
select category as label, {_MONEY}, {_PCT}
from (select category, total_amount from industries union all select category, total_amount from bins)
"""
ORACLE["step_forward_two"] = _q("survey", _STEPS, recursive=True)
ORACLE["step_backward_two"] = _q("survey", _STEPS_BACK, recursive=True)
ORACLE["step_both_two"] = ORACLE["step_backward_two"]  # what was dropped never pays again
ORACLE["lasso_nonzero_two"] = (
    f"select term, coefficient from ({_elastic(0.02, 1.0)}) where abs(coefficient) > 0"
)
ORACLE["contrib_combined_share"] = _contrib(_COMBINED)
ORACLE["contrib_stacked_share"] = _contrib(_COMBINED)
for _name, (_table, _column) in {
    "ingested": ("layer_ingested", "meta_lineage_source_name"),
    "standardized": ("layer_standardized", "meta_lineage_source_name"),
    "shared": ("layer_shared", "FileName"),
}.items():
    ORACLE[f"{_name}_files_by_month"] = _layer(_table, _column, 7)
    ORACLE[f"{_name}_files_by_year"] = _layer(_table, _column, 4)
ORACLE["ingested_files_both_grains"] = f"""
select 'month' as grain, * from ({ORACLE["ingested_files_by_month"]})
union all select 'year', * from ({ORACLE["ingested_files_by_year"]})
"""

# a layer of two tables, apart and together
_NAME = "meta_lineage_source_name"
_INGESTED = _layer("layer_ingested", _NAME, 4)


def _only(condition: str) -> str:
    return _INGESTED.replace("from layer_ingested) l", f"from layer_ingested where {condition}) l")


ORACLE["layer_list_by_year"] = f"""
select 'all' as tables, * from ({_INGESTED})
union all select 'packed', * from ({_only(f"{_NAME} like '%.bz2'")})
"""
ORACLE["contrib_org_rows"] = _contrib(
    """
select filer, filer_id, contributor_code, contributor_first, contributor_last, contributor_city,
       cast(amount as double) as amount
from rows_a where (contributor_first is null or contributor_first = '')
"""
)
ORACLE["shared_not_linked_pairs"] = _status(
    """
select trading_partner_id, table_type_ingested, shared_completed from status s
where shared_completed = 'True' and not exists (
  select 1 from status k where k.account_linking_completed = 'True'
    and k.trading_partner_id = s.trading_partner_id and k.table_type_ingested = s.table_type_ingested)
"""
)
ORACLE["coef_sizes_two"] = f"""
select term, coefficient, case when abs(coefficient) > 0.1 then 'large' else 'near zero' end as size
from ({_elastic(0.1, 0.0)})
"""


def _slots(coding: str, whole: str | None) -> str:
    """Sums of a design's columns: numbers, and factors without their first level."""
    numbers = ["age", "experience_years", "remote_hours", "job_satisfaction", "tech_tools", "salary"]
    parts = [f"select '{n}' as slot, cast(sum({n}) as double) as total from survey" for n in numbers]
    for f in ("country", "job_role", "company_size"):
        first = "" if f == whole else f" where {f} > (select min({f}) from survey)"
        parts.append(f"select '{f}_' || {f}, cast(count(*) as double) from survey{first} group by {f}")
    body = " union all ".join(parts)
    return f"select '{coding}' as coding, slot, round(total, 4) as total from ({body})"


ORACLE["factor_design_sums"] = _q(
    "survey", f"\n{_slots('intercept', None)}\nunion all {_slots('no intercept', 'country')}"
)
# one split in each of three folds, chosen by the impurity left on the other two
ORACLE["tree_stump_two"] = _q(
    "survey",
    """,
folds(f) as (select * from range(3)),
train as (select f, preference as y, job_satisfaction, tech_tools from survey, folds where row_id % 3 <> f),
points as (
  select f, 0 as place, job_satisfaction as x, y from train
  union all select f, 1, tech_tools, y from train
),
cuts as (select distinct f, place, x as cut from points),
sides as (
  select c.f, c.place, c.cut, count(*) as n, sum(y) as p,
         count(*) filter (where x <= cut) as nl, coalesce(sum(y) filter (where x <= cut), 0) as pl
  from cuts c join points t on t.f = c.f and t.place = c.place group by 1, 2, 3
),
best as (
  select * from (
    select *, row_number() over (partition by f order by
        nl * 2.0 * (pl / nl) * (1 - pl / nl) + (n - nl) * 2.0 * ((p - pl) / (n - nl)) * (1 - (p - pl) / (n - nl)),
        place, cut) as r
    from sides where nl < n
  ) where r = 1
),
hits as (
  select b.f, avg(case when s.preference = (case
           when (case when b.place = 0 then s.job_satisfaction else s.tech_tools end) <= b.cut
             then cast(2 * b.pl > b.nl as int)
           else cast(2 * (b.p - b.pl) > b.n - b.nl as int) end) then 1.0 else 0.0 end) as share
  from best b join survey s on s.row_id % 3 = b.f group by b.f
)
select 1 as max_depth, 0.0::double as min_info_gain, round(avg(share), 6) as accuracy, true as is_best from hits
""",
)


def _cv(penalty: tuple[str, ...], scaled: bool, lambdas: tuple[float, ...], start: str) -> str:
    """Held-out deviance at each penalty over three folds, by Newton's method for all
    of them at once; see ``_NEWTON``."""
    q1, q2, p11, p12, p22 = penalty
    lams = ", ".join(f"({lam}::double)" for lam in lambdas)
    where = "filter (where row_id % 3 <> f)"
    m = (lambda c: f"avg({c}) {where}") if scaled else (lambda c: "0::double")
    sd = (lambda c: f"stddev_pop({c}) {where}") if scaled else (lambda c: "1::double")
    return _q(
        "survey",
        f""",
folds(f) as (select * from range(3)),
lams(lam) as (values {lams}),
stats as (
  select f, {m("job_satisfaction")} as m1, {sd("job_satisfaction")} as s1,
         {m("remote_hours")} as m2, {sd("remote_hours")} as s2
  from survey, folds group by f
),
data as (
  select lam, f, row_id % 3 = f as held, cast(preference as double) as y,
         (job_satisfaction - m1) / s1 as x1, (remote_hours - m2) / s2 as x2
  from survey, stats, lams
),
fit(i, lam, f, b0, b1, b2) as (
  select 0, lam, f, 0::double, {start}::double, {start}::double from lams, folds
  union all
  select i + 1, lam, f, b0 + (k00 * g0 + k01 * g1 + k02 * g2) / det,
         b1 + (k01 * g0 + k11 * g1 + k12 * g2) / det, b2 + (k02 * g0 + k12 * g1 + k22 * g2) / det
  from (
    select *, h00 * k00 + h01 * k01 + h02 * k02 as det
    from (
      select *, h11 * h22 - h12 * h12 as k00, h02 * h12 - h01 * h22 as k01, h01 * h12 - h02 * h11 as k02,
             h00 * h22 - h02 * h02 as k11, h01 * h02 - h00 * h12 as k12, h00 * h11 - h01 * h01 as k22
      from (
        select i, lam, f, b0, b1, b2, sum(w) as h00, sum(w * x1) as h01, sum(w * x2) as h02,
               sum(w * x1 * x1 + ({p11})) as h11, sum(w * x1 * x2 + ({p12})) as h12,
               sum(w * x2 * x2 + ({p22})) as h22,
               sum(y - p) as g0, sum((y - p) * x1 - ({q1})) as g1, sum((y - p) * x2 - ({q2})) as g2
        from (
          select *, p * (1 - p) as w
          from (
            select t.i, t.lam, t.f, t.b0, t.b1, t.b2, d.x1, d.x2, d.y,
                   1 / (1 + exp(-(t.b0 + t.b1 * d.x1 + t.b2 * d.x2))) as p
            from fit t join data d on d.lam = t.lam and d.f = t.f where t.i < 20 and not d.held
          )
        ) group by i, lam, f, b0, b1, b2
      )
    )
  )
),
losses as (
  select d.lam, d.f, count(*) as n,
         sum(2 * (ln(1 + exp(b0 + b1 * x1 + b2 * x2)) - y * (b0 + b1 * x1 + b2 * x2))) as loss
  from data d join fit t on t.lam = d.lam and t.f = d.f where d.held and t.i = 20 group by 1, 2
),
means as (select lam, sum(loss) / sum(n) as mean from losses group by lam),
rows as (
  select lam, mean, sqrt(sum(n * power(loss / n - mean, 2)) / sum(n) / 2) as err
  from losses join means using (lam) group by lam, mean
)
select lam as lambda, round(mean, 4) as deviance, round(err, 4) as std_error,
       mean = min(mean) over () as is_best
from rows
""",
        recursive=True,
    )


def _elastic_penalty(alpha: float) -> tuple[str, ...]:
    l1, l2 = f"lam * {alpha}", f"lam * {1 - alpha}"
    return (f"{l1} + {l2} * b1", f"{l1} + {l2} * b2", l2, "0", l2)


ORACLE["ridge_cv_two"] = _cv(_elastic_penalty(0.0), True, (0.1, 0.01), "0")
ORACLE["lasso_cv_two"] = _cv(_elastic_penalty(1.0), True, (0.05, 0.01), "0")
ORACLE["enet_cv_two"] = _cv(_elastic_penalty(0.5), True, (0.05, 0.01), "0")
ORACLE["group_lasso_cv_two"] = _cv(
    tuple(p.replace(_W, "lam * sqrt(2)") for p in _GROUP), False, (0.05, 0.01), "0.01"
)

# labels, numbers out of text, and given levels
ORACLE["survey_recoded"] = _q(
    "survey",
    """
select row_id, cast(company_size = 'small' as int) as is_small,
       case when preference = 0 then -1 else 1 end as signed,
       case when row_id % 2 = 0 then cast(salary as double) end as number,
       case when country in ('ASIA', 'EUROPE') then country end as known_country
from survey
""",
)
ORACLE["ridge_path_two"] = " union all ".join(
    f"select * from ({_elastic(lam, 0.0)})" for lam in (0.1, 0.01)
)
ORACLE["enet_path_two"] = " union all ".join(
    f"select * from ({_elastic(lam, 0.5)})" for lam in (0.05, 0.02)
)
ORACLE["contributions_from_csv"] = _contrib(
    """
select contributor_code, count(*) as n_rows, cast(coalesce(sum(amount), 0) as double) as total_amount
from rows_a group by 1
"""
)
for _mark, _text in {
    "NO_SHARED": NO_SHARED, "NO_STANDARDIZED": NO_STANDARDIZED, "MISSING_TYPE": MISSING_TYPE,
    "TYPES_MATCH": TYPES_MATCH, "TYPES_DIFFER": TYPES_DIFFER,
}.items():
    ORACLE = {k: v.replace(f"@{_mark}@", _text.replace("'", "''")) for k, v in ORACLE.items()}

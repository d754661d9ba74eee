"""Every table of the star schema as a query, over the test tables written as raw releases, with the SQL that gives the same table."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import checks
from lodestack.plans import hospital_models as H
from lodestack.plans.hospital_metrics import hospital_layer
from lodestack.plans.hospital_models import CHRONIC, HOSPITAL, RETIRED_TOPICS, SOCIAL, TOPICS
from lodestack.queries import releases
from lodestack.session import cut

#: A sum of doubles, compared to six decimals, as the order of additions is free.
SUMS = ("unadjusted_penalty",)


def built(spark: SparkSession, d: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables as plans, with what they need; what more than one table needs is computed once."""
    tables = dict(releases.sources(spark, d))
    order = HOSPITAL.order(list(names))
    needs = [n for x in order for n in HOSPITAL.nodes[x].needs] + list(names) * (len(names) > 1)
    for x in order:
        made = HOSPITAL.nodes[x].build(tables)
        tables[x] = cut(made) if needs.count(x) > (x in names) else made
    return tables


def model(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = built(spark, d, [name])[name]
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in SUMS})


def _key(c: str) -> str:
    """Letters of a county name."""
    return f"""replace(regexp_replace(regexp_replace(regexp_replace(upper(strip_accents(trim({c}))), '[.''’]', '', 'g'), '\\bSAINT ', 'ST ', 'g'), ' (CITY AND BOROUGH|CENSUS AREA|MUNICIPALITY|COUNTY|PARISH|BOROUGH)$', ''), ' ', '')"""


def _survey_columns(topics: dict[str, str]) -> str:
    parts = [f"max({column}) filter (where measure_id = 'H_{k}_{kind}') as {v}_{name}" for column, kind, name in (("linear_mean_score", "LINEAR_SCORE", "score"), ("star_rating", "STAR_RATING", "stars")) for k, v in topics.items()]
    return ", ".join([*parts, "max(star_rating) filter (where measure_id = 'H_STAR_RATING') as summary_stars", "max(completed_surveys) as completed_surveys", "max(response_rate_pct) as response_rate_pct"])


_TOPICS = TOPICS | RETIRED_TOPICS
_HEALTH = CHRONIC | SOCIAL
_PROFILE = "facility_id, facility_name, address, city, state, zip_code, county_name, hospital_type, ownership, has_emergency_services"
_MADE = releases.SQL | {
    "int_zip_county": """select zcta, county_fips, left(county_fips, 2) as state_fips, county_name, land_area_part, land_area_part / sum(land_area_part) over (partition by zcta) as land_share, count(*) over (partition by zcta) as zcta_county_count from (
select zcta, county_fips, county_name, land_area_part from stg_zip_county where zcta is not null and not starts_with(county_fips, '09')
union all select zcta, planning_region_fips, r.county_name || ' Planning Region', cast(sum(land_area_part) as bigint) from stg_zip_town t left join (select distinct county_fips, county_name from stg_county_health where state = 'CT') r on r.county_fips = planning_region_fips
where zcta is not null and is_town group by all) where land_area_part > 0""",
    "int_survey_scores": f"select facility_id, {_survey_columns(TOPICS)}, max(period_start) as period_start, max(period_end) as period_end, max(source_release) as source_release from stg_survey group by all",
    "int_survey_by_window": f"select facility_id, period_start, period_end, {_survey_columns(_TOPICS)}, max(source_release) as source_release from stg_survey_history group by all",
    "int_profile": f"""select {_PROFILE}, is_birthing_friendly, overall_star_rating, 'current' as profile_source, cast(source_release as date) as profile_date from stg_hospitals
union all select {_PROFILE}, null, overall_star_rating, 'archive', snapshot_date from stg_hospitals_history where facility_id not in (select facility_id from stg_hospitals) qualify snapshot_date = max(snapshot_date) over (partition by facility_id)""",
    "int_hospital_county": f"""select *, case when name_county_fips is not null and county_fips is not null then name_county_fips <> county_fips end as name_disagrees from (
select facility_id, state, zip_code, cms_county_name, case when link_method[1:4] = 'zip_' then zip_county_fips when link_method = 'ct_town' then town_fips when link_method = 'name_only' then named_fips when link_method = 'single_county_state' then single_fips end as county_fips,
link_method, link_method in ('zip_single_county', 'zip_name_agrees') as is_high_confidence, zcta_county_count, zip_land_share, named_fips as name_county_fips from (
select p.*, b.*exclude(bid), t.region as town_fips, n.fips as named_fips, s.fips as single_fips, case when p.state_fips is null then 'no_places_data' when zcta_county_count = 1 then 'zip_single_county' when zip_name_matches then 'zip_name_agrees'
when zip_county_fips is not null then 'zip_largest_area' when t.region is not null then 'ct_town' when n.fips is not null then 'name_only' when s.fips is not null then 'single_county_state' else 'unmatched' end as link_method
from _placed p left join (select p.facility_id as bid, z.county_fips as zip_county_fips, zcta_county_count, land_share as zip_land_share, {_key('z.county_name')} = name_key as zip_name_matches from _placed p join int_zip_county z on z.zcta = p.zip_code
qualify row_number() over (partition by p.facility_id order by {_key('z.county_name')} = name_key desc nulls last, z.state_fips = p.state_fips desc nulls last, land_share desc nulls last, z.county_fips) = 1) b on b.bid = p.facility_id
left join (select distinct {_key("regexp_replace(town_name, ' town$', '')")} as k, planning_region_fips as region from stg_zip_town where is_town) t on p.state = 'CT' and t.k = {_key('p.city')}
left join (select state_fips, name_key, min(county_fips) as fips from _known group by all having count(*) = 1) n on n.state_fips = p.state_fips and n.name_key = p.name_key
left join (select state_fips, min(county_fips) as fips from _known group by all having count(*) = 1) s on s.state_fips = p.state_fips))""",
    "_placed": f"""select facility_id, h.state, city, zip_code, county_name as cms_county_name, {_key('county_name')} as name_key, state_fips from int_profile h left join (select distinct state, left(county_fips, 2) as state_fips from stg_county_health) s on s.state = h.state""",
    "_known": f"select distinct county_fips, state_fips, {_key('county_name')} as name_key from stg_zip_county where county_fips in (select county_fips from stg_county_health)",
    "dim_county": f"""select c.*, a.* exclude(fips), a.chronic_data_year is not null as has_chronic_measures, a.social_data_year is not null as has_social_measures from (
select county_fips, any_value(county_name) as county_name, any_value(state) as state, any_value(state_name) as state_name, any_value(total_population) as total_population, any_value(adult_population) as adult_population, any_value(latitude) as latitude, any_value(longitude) as longitude,
any_value(source_release) as source_release from stg_county_health group by all) c left join (select county_fips as fips, {', '.join(f"max(value_pct) filter (where measure_id = '{k}') as {v}_pct" for k, v in _HEALTH.items())},
max(data_year) filter (where measure_id = 'DIABETES') as chronic_data_year, max(data_year) filter (where measure_id = 'LACKTRPT') as social_data_year from stg_county_health where value_type = 'AgeAdjPrv' group by all) a on a.fips = c.county_fips""",
    "dim_hospital": """select k.facility_id, coalesce(p.facility_name, n.facility_name, h.facility_name) as facility_name, p.address, p.city, coalesce(p.state, n.state, h.state) as state, p.zip_code, p.county_name as cms_county_name, l.county_fips, coalesce(l.link_method, 'no_hospital_profile') as county_link_method,
coalesce(l.is_high_confidence, false) as is_county_link_high_confidence, l.name_disagrees as county_name_disagrees, p.hospital_type, p.ownership, p.has_emergency_services, p.is_birthing_friendly, p.overall_star_rating, p.facility_id is not null as has_hospital_profile, p.profile_source,
coalesce(p.profile_source = 'current', false) or n.facility_id is not null or c.facility_id is not null as is_active, n.facility_id is not null as is_hrrp_hospital, c.facility_id is not null as is_in_penalty_calculation, p.profile_date
from (select facility_id from int_profile union select facility_id from stg_results union select facility_id from stg_results_history union select facility_id from stg_payment_adjustments) k
left join int_profile p using (facility_id) left join (select facility_id, max(facility_name) as facility_name, max(state) as state from stg_results group by all) n using (facility_id)
left join (select facility_id, max(facility_name) as facility_name, max(state) as state from stg_results_history group by all) h using (facility_id)
left join (select distinct facility_id from stg_payment_adjustments where is_latest_fiscal_year) c using (facility_id) left join int_hospital_county l using (facility_id)""",
    "dim_fiscal_year": """select fiscal_year, readmission_period_start, readmission_period_end, readmission_results_published, survey_period_start, survey_period_end, make_date(y - 1, 10, 1) as fiscal_year_start, make_date(y, 9, 30) as fiscal_year_end,
cast(date_diff('month', survey_period_start, survey_period_end + 1) as int) as survey_period_months, cast(readmission_period_end - survey_period_end as int) as survey_ends_days_before_readmissions,
fiscal_year in (select fiscal_year from stg_payment_adjustments) as has_payment_file, fiscal_year = max(fiscal_year) over () as is_latest_fiscal_year from (
select 'FY' || (year(p.period_start) + 5) as fiscal_year, year(p.period_start) + 5 as y, p.period_start as readmission_period_start, p.period_end as readmission_period_end, cast(any_value(period_first_release) as date) as readmission_results_published,
arg_max(s.period_start, (s.period_end, -epoch(s.period_start))) as survey_period_start, max(s.period_end) as survey_period_end from stg_results_history p
left join (select distinct period_start, period_end from stg_survey_history) s on s.period_end <= p.period_end group by all)""",
    "fct_readmissions": """select *, make_date(cast(substr(fiscal_year, 3) as int) - 1, 10, 1) as fiscal_year_start, case when counts_toward_penalty then drg_payment_ratio * (payment_excess_readmission_ratio - peer_group_median_err) when in_payment_file then 0.0 end as penalty_contribution from (
select coalesce(a.facility_id, b.facility_id) as facility_id, coalesce(a.condition, b.condition) as condition, coalesce(a.fiscal_year, b.fiscal_year) as fiscal_year, discharges, readmissions, readmissions_suppressed, predicted_readmission_rate, expected_readmission_rate, a.excess_readmission_ratio,
score_status, footnote_code, a.facility_id is not null as in_public_file, eligible_discharges, b.excess_readmission_ratio as payment_excess_readmission_ratio, peer_group_median_err, is_above_peer_median as counts_toward_penalty, drg_payment_ratio, b.facility_id is not null as in_payment_file
from (select *, 'FY' || (year(period_start) + 5) as fiscal_year from stg_results_history) a full join stg_peer_comparisons b on a.facility_id = b.facility_id and a.condition = b.condition and a.fiscal_year = b.fiscal_year)""",
    "fct_hospital_year": f"""select r.fiscal_year, r.facility_id, r.* exclude(fiscal_year, facility_id), y.fiscal_year_start, y.survey_period_start, y.survey_period_end, h.snapshot_date as profile_snapshot_date, h.hospital_type, h.ownership, h.has_emergency_services,
p.* exclude(facility_id, fiscal_year, is_latest_fiscal_year, ingested_at), p.facility_id is not null as in_payment_file, s.* exclude(facility_id, period_start, period_end, source_release), s.facility_id is not null as has_survey_scores from (
select fiscal_year, facility_id, count(excess_readmission_ratio) as conditions_with_public_ratio, count(*) filter (where counts_toward_penalty) as conditions_counting_toward_penalty, cast(sum(discharges) as bigint) as public_discharges, sum(penalty_contribution) as unadjusted_penalty
from fct_readmissions group by all) r join dim_fiscal_year y using (fiscal_year) left join (select r.fiscal_year, h.* from (select distinct fiscal_year, facility_id from fct_readmissions) r join dim_fiscal_year y using (fiscal_year) join stg_hospitals_history h using (facility_id)
qualify row_number() over (partition by r.fiscal_year, h.facility_id order by snapshot_date >= readmission_period_end desc, abs(snapshot_date - readmission_period_end)) = 1) h on h.facility_id = r.facility_id and h.fiscal_year = r.fiscal_year
left join stg_payment_adjustments p on p.facility_id = r.facility_id and p.fiscal_year = r.fiscal_year left join int_survey_by_window s on s.facility_id = r.facility_id and s.period_start = y.survey_period_start and s.period_end = y.survey_period_end""",
    "ml_penalty_features": f"""select h.facility_id, h.fiscal_year, case when h.fiscal_year = t.fiscal_year then 'test' when y.readmission_period_end < t.readmission_period_start then 'train' else 'overlap_unused' end as split, payment_reduction_pct, is_penalized,
payment_reduction_pct >= quantile_cont(payment_reduction_pct, 0.75) over (partition by h.fiscal_year) as is_top_quarter_penalty, v.eligible_discharges, v.conditions_with_25_cases, dual_proportion, peer_group, has_survey_scores, {', '.join(f'{v}_score' for v in _TOPICS.values())},
completed_surveys, response_rate_pct, h.ownership, h.has_emergency_services, c.total_population as county_population, {', '.join(f'c.{v}_pct as county_{v}_pct' for v in _HEALTH.values())}, e.prior_weighted_err, e.prior_conditions_scored, q.prior as prior_payment_reduction_pct
from fct_hospital_year h join dim_fiscal_year y using (fiscal_year), (select fiscal_year, readmission_period_start from dim_fiscal_year where fiscal_year = (select max(fiscal_year) from stg_payment_adjustments)) t
join (select facility_id, fiscal_year, cast(sum(eligible_discharges) as int) as eligible_discharges, cast(count(*) filter (where eligible_discharges >= 25) as int) as conditions_with_25_cases from fct_readmissions where in_payment_file group by all) v on v.facility_id = h.facility_id and v.fiscal_year = h.fiscal_year
join dim_hospital d on d.facility_id = h.facility_id left join dim_county c on c.county_fips = d.county_fips
left join (select facility_id, 'FY' || (cast(substr(fiscal_year, 3) as int) + 3) as fy, cast(sum(cast(excess_readmission_ratio as decimal(18,6)) * discharges) as double) / cast(sum(discharges) as double) as prior_weighted_err, cast(count(excess_readmission_ratio) as int) as prior_conditions_scored
from fct_readmissions where excess_readmission_ratio is not null and discharges > 0 group by all) e on e.facility_id = h.facility_id and e.fy = h.fiscal_year
left join (select facility_id, 'FY' || (cast(substr(fiscal_year, 3) as int) + 3) as fy, payment_reduction_pct as prior from stg_payment_adjustments) q on q.facility_id = h.facility_id and q.fy = h.fiscal_year where in_payment_file""",
    "time_spine": "select cast(unnest(generate_series(timestamp '2018-01-01', timestamp '2030-12-31', interval 1 day)) as date) as date_day",
}
_ORDER = [*releases.SQL, "int_zip_county", "int_survey_scores", "int_survey_by_window", "int_profile", "_placed", "_known", "int_hospital_county", "dim_county", "dim_hospital", "dim_fiscal_year", "fct_readmissions", "fct_hospital_year", "ml_penalty_features", "time_spine"]


#: Names of built tables that test tables have too; within the SQL the built ones get a sign more.
TAKEN = ("fct_readmissions", "ml_penalty_features")


def _words(sql: str) -> set[str]:
    return set(sql.translate(str.maketrans("(),", "   ")).split())


def with_tables(select: str) -> str:
    """A query over built tables, of which only those come along that it needs. Staging reads the test tables."""
    wanted: list[str] = []
    todo = [(select, False)]
    while todo:
        text, staging = todo.pop()
        for name in _ORDER:
            if name not in wanted and name in _words(text) and not (staging and name in TAKEN):
                wanted.append(name)
                todo.append((_MADE[name], name in releases.SQL))
    parts = [f"{_built(n)} as materialized ({_MADE[n] if n in releases.SQL else _built(_MADE[n])})" for n in _ORDER if n in wanted]
    return f"with {', '.join(parts)} {_built(select)}"


def _built(sql: str) -> str:
    for name in TAKEN:
        sql = re.sub(rf"(?<!')\b{name}\b", f"{name}_", sql)
    return sql


def _select(name: str) -> str:
    return "select * replace (round(unadjusted_penalty, 6) as unadjusted_penalty) from fct_hospital_year" if name == "fct_hospital_year" else f"select * from {name}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"model_{n}": partial(model, name=n) for n in HOSPITAL.nodes}
SQL = {f"model_{n}": with_tables(_select(n)) for n in HOSPITAL.nodes}


# Checks


def _failures(spark: SparkSession, d: str, names: Sequence[str]) -> DataFrame:
    """(``check``, ``failures``) of all declared rules of some tables, rules on single rows in one pass a table."""
    t = built(spark, d, names)
    parts = []
    for name in names:
        rules = H.row_rules(name)
        parts.append(checks.failure_counts(t[name], {n: bad for n, (bad, _) in rules.items()}))
        parts.append(checks.summary(spark, {n: failing for n, (failing, _) in H.table_rules(name, t).items()}) if H.table_rules(name, t) else None)
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def _failures_sql(names: Sequence[str]) -> str:
    parts = []
    for name in names:
        own, bad = H.RULES[name], {}
        bad |= {f"{x}_not_null": f"{x} is null" for x in own.get("not_null", ())}
        bad |= {f"{x}_form": f"not regexp_full_match({x}, '{p}')" for x, p in own.get("form", {}).items()}
        bad |= {f"{x}_accepted": f"{x} not in ({', '.join(repr(v) for v in values)})" for x, values in own.get("accepted", {}).items()}
        bad |= {f"{x}_range": " or ".join([f"{x} < {low}"] * (low is not None) + [f"{x} > {high}"] * (high is not None)) for x, (low, high) in own.get("ranges", {}).items()}
        bad |= {n: f"not ({rule})" for n, rule in own.get("rules", {}).items()}
        counts = ", ".join(f"count(*) filter (where {b})" for b in bad.values())
        labels = ", ".join(f"'{name}.{n}'" for n in bad)
        parts.append(f"select unnest([{labels}]) as \"check\", unnest([{counts}]) as failures from {name}")
        if "key" in own:
            known = f"where {own['key'][0]} is not null" if len(own["key"]) == 1 else ""
            parts.append(f"select '{name}.key', count(*) from (select 1 from {name} {known} group by {', '.join(own['key'])} having count(*) > 1)")
        for x, (parent, column) in own.get("parents", {}).items():
            if parent in names or parent in _needed(name):
                parts.append(f"select '{name}.{x}_parent', count(*) from {name} where {x} is not null and {x} not in (select {column} from {parent} where {column} is not null)")
    return with_tables(" union all ".join(parts))


def _needed(name: str) -> set[str]:
    return set(HOSPITAL.order([name]))


STAGING = [n for n, node in HOSPITAL.nodes.items() if node.layer in ("staging", "intermediate")]
MARTS = ["dim_county", "dim_hospital", "dim_fiscal_year", "fct_readmissions", "fct_hospital_year", "ml_penalty_features", "time_spine"]


def checks_staging(spark: SparkSession, d: str) -> DataFrame:
    """Failures of every rule of the staging and intermediate tables."""
    return _failures(spark, d, STAGING)


def checks_marts(spark: SparkSession, d: str) -> DataFrame:
    """Failures of every rule of facts, dimensions and features."""
    return _failures(spark, d, MARTS)


def checks_singular(spark: SparkSession, d: str) -> DataFrame:
    """Failures of the checks that look at several columns or tables, leakage guards among them."""
    t = built(spark, d, [*MARTS, "stg_results"])
    return checks.summary(spark, {n: failing for name in [*_needed("ml_penalty_features"), "stg_results_history"] if name in t for n, (failing, _) in H.singular_checks(name, t).items()})


_CONDITION_LIST = ", ".join(f"('{c}')" for c in H.CONDITIONS)
_PRIOR = "select f.facility_id, f.fiscal_year from ml_penalty_features f join dim_fiscal_year y using (fiscal_year) left join (select 'FY' || (cast(substr(fiscal_year, 3) as int) + {by}) as fiscal_year, readmission_period_end as prior_end from dim_fiscal_year) p on p.fiscal_year = f.fiscal_year where (f.prior_payment_reduction_pct is not null or f.prior_weighted_err is not null) and (prior_end is null or prior_end >= y.readmission_period_start)"
_SINGULAR = {
    "stg_results_history.one_period_per_release": "select source_release from stg_results_history group by all having count(distinct (period_start, period_end)) > 1",
    "stg_results_history.history_ends_as_live": """(select facility_id, condition, excess_readmission_ratio, discharges from stg_results except select facility_id, condition, excess_readmission_ratio, discharges from stg_results_history where period_start = (select max(period_start) from stg_results_history))
union all (select facility_id, condition, excess_readmission_ratio, discharges from stg_results_history where period_start = (select max(period_start) from stg_results_history) except select facility_id, condition, excess_readmission_ratio, discharges from stg_results)""",
    "stg_peer_comparisons.conditions_per_year": f"select y.fiscal_year, c from (select distinct fiscal_year from stg_peer_comparisons) y, (values {_CONDITION_LIST}) v(c) where (y.fiscal_year, c) not in (select (fiscal_year, condition) from stg_peer_comparisons) and not (y.fiscal_year = 'FY2023' and c = 'PN')",
    "dim_county.pivot_keeps_values": "select 1 from stg_county_health h join dim_county d using (county_fips) where value_type = 'AgeAdjPrv' and value_pct is not null and value_pct is distinct from case measure_id " + " ".join(f"when '{k}' then d.{v}_pct" for k, v in _HEALTH.items()) + " end",
    "dim_hospital.covers_sources": "select facility_id from (select facility_id from stg_results union select facility_id from stg_results_history union select facility_id from stg_payment_adjustments union select facility_id from int_profile) where facility_id not in (select facility_id from dim_hospital)",
    "dim_hospital.golden_counties": f"select k from (values {', '.join(f'({k!r}, {v!r})' for k, v in H.GOLDEN_COUNTIES.items())}) g(k, want) left join dim_hospital d on d.facility_id = k where d.county_fips is distinct from want",
    "dim_hospital.counties_linked": f"select 1 from dim_hospital where has_hospital_profile having count(county_fips) < {H.LEAST_LINKED} * count(*)",
    "dim_fiscal_year.no_survey_after_period": "select 1 from dim_fiscal_year where survey_period_end > readmission_period_end",
    "fct_readmissions.covers_sources": "select 1 from (select facility_id, condition, 'FY' || (year(period_start) + 5) as fiscal_year from stg_results_history union all select facility_id, condition, fiscal_year from stg_peer_comparisons) s where (facility_id, condition, fiscal_year) not in (select (facility_id, condition, fiscal_year) from fct_readmissions)",
    "fct_hospital_year.penalty_recomputes": "select 1 from fct_hospital_year where in_payment_file and abs(payment_reduction_pct - least(unadjusted_penalty * neutrality_modifier * 100, 3.0)) > 0.01",
    "fct_hospital_year.surveys_cover_year": f"select fiscal_year from fct_hospital_year where in_payment_file and survey_period_end is not null group by all having avg(cast(has_survey_scores as int)) < {H.LEAST_SURVEYED}",
    "ml_penalty_features.no_shared_patients": "select 1 from ml_penalty_features join dim_fiscal_year using (fiscal_year) where split = 'train' and readmission_period_end >= (select min(readmission_period_start) from ml_penalty_features join dim_fiscal_year using (fiscal_year) where split = 'test')",
    "ml_penalty_features.prior_before_target": _PRIOR.format(by=H.PRIOR_YEARS),
    "ml_penalty_features.covers_payments": "select 1 from stg_payment_adjustments where (facility_id, fiscal_year) not in (select (facility_id, fiscal_year) from ml_penalty_features)",
}


def _counted(failing: dict[str, str]) -> str:
    return with_tables(" union all ".join(f"select '{n}' as \"check\", count(*) as failures from ({sql})" for n, sql in failing.items()))


def dq_guards(spark: SparkSession, d: str) -> DataFrame:
    """The leakage guards on tables that break them: surveys that end a year later, years with shared patients trained on, and earlier
    results of only a year before."""
    t = built(spark, d, ["ml_penalty_features", "dim_fiscal_year"])
    years, features = t["dim_fiscal_year"], t["ml_penalty_features"]
    late = years.withColumn("survey_period_end", F.date_add("survey_period_end", 365))
    mixed = features.withColumn("split", F.when(F.col("split") == "overlap_unused", "train").otherwise(F.col("split")))
    parts = {"survey_after_period": H.survey_after_period(late).select("fiscal_year"), "shared_patients": H.shared_patients(mixed, years).select("fiscal_year"), "prior_after_target": H.prior_after_target(features, years, 1).select("fiscal_year")}
    rows = reduce(DataFrame.unionByName, [df.withColumn("guard", F.lit(n)) for n, df in parts.items()])
    return rows.groupBy("guard", "fiscal_year").agg(F.count(F.lit(1)).alias("failures"))


_GUARDS = f"""select guard, fiscal_year, count(*) as failures from (select 'survey_after_period' as guard, fiscal_year from dim_fiscal_year where survey_period_end + 365 > readmission_period_end
union all select 'shared_patients', f.fiscal_year from ml_penalty_features f join dim_fiscal_year y using (fiscal_year) where split in ('train', 'overlap_unused') and y.readmission_period_end >= (select min(readmission_period_start) from ml_penalty_features join dim_fiscal_year using (fiscal_year) where split = 'test')
union all select 'prior_after_target', fiscal_year from ({_PRIOR.format(by=1)})) group by all"""

# Metrics over the built tables


def metric_star_years(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of hospital years by fiscal year, survey scores among them."""
    names = ["hospitals_in_payment_file", "penalized_hospitals", "share_penalized", "max_payment_reduction_pct", *(f"avg_{x}_score" for x in ("recommend", "overall_rating", "care_transition", "discharge_information"))]
    t = built(spark, d, ["fct_hospital_year", "dim_fiscal_year", "dim_hospital", "dim_county", "fct_readmissions"])
    out = hospital_layer(t.__getitem__).query(names, ["fiscal_year"])
    return out.withColumns({c: F.round(c, 6) for c in names if c.startswith(("share", "avg"))})


def metric_star_states(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two facts by a dimension two joins away."""
    t = built(spark, d, ["fct_hospital_year", "dim_fiscal_year", "dim_hospital", "dim_county", "fct_readmissions"])
    out = hospital_layer(t.__getitem__).query(["share_penalized", "scored_results", "eligible_discharges"], ["hospital__county__state_name"])
    return out.withColumn("share_penalized", F.round("share_penalized", 6))


_SCORES = ", ".join(f"round(avg({x}_score), 6) as avg_{x}_score" for x in ("recommend", "overall_rating", "care_transition", "discharge_information"))
_SHARE = "round(cast(sum(case when is_penalized then 1 else 0 end) as double) / nullif(sum(case when in_payment_file then 1 else 0 end), 0), 6) as share_penalized"
_STAR_YEARS = f"""select fiscal_year, cast(sum(case when in_payment_file then 1 else 0 end) as bigint) as hospitals_in_payment_file, cast(sum(case when is_penalized then 1 else 0 end) as bigint) as penalized_hospitals, {_SHARE},
max(payment_reduction_pct) as max_payment_reduction_pct, {_SCORES} from fct_hospital_year group by all"""
_STATE = "left join dim_hospital d on d.facility_id = f.facility_id left join dim_county c on c.county_fips = d.county_fips group by all"
_STAR_STATES = f"""select coalesce(a.s, b.s) as hospital__county__state_name, share_penalized, scored_results, eligible_discharges from (select c.state_name as s, {_SHARE} from fct_hospital_year f {_STATE}) a
full join (select c.state_name as s, count(excess_readmission_ratio) as scored_results, cast(sum(eligible_discharges) as bigint) as eligible_discharges from fct_readmissions f {_STATE}) b on a.s is not distinct from b.s"""

QUERIES |= {f.__name__: f for f in (metric_star_years, metric_star_states, checks_staging, checks_marts, checks_singular, dq_guards)}
SQL |= {"metric_star_years": with_tables(_STAR_YEARS), "metric_star_states": with_tables(_STAR_STATES), "checks_staging": _failures_sql(STAGING), "checks_marts": _failures_sql(MARTS), "checks_singular": _counted(_SINGULAR), "dq_guards": with_tables(_GUARDS)}

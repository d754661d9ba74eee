"""One query for each kind of operator, over whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack import checks, export
from lodestack.functions.values import clean_county_name, facility_number, to_number
from lodestack.operators import ordering as O
from lodestack.operators import relations as R
from lodestack.operators.ranking import last_row
from lodestack.plans.hospital_metrics import hospital_layer
from lodestack.plans.hospital_models import score_status
from lodestack.plans.questions import Agent, Plan, Scripted
from lodestack.plans.semantic import Filter, Measure, Metric, MetricLayer, Model
from lodestack.queries import tables as Q
from lodestack.session import ensure_checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Columns


@query(f"select record_id, {Q.number_sql('patient_survey_star_rating', 'int')} as stars, {Q.number_sql('hcahps_linear_mean_value', 'int')} as score, {Q.number_sql('number_of_completed_surveys', 'int')} as surveys, {Q.number_sql('survey_response_rate_percent')} as rate from hcahps_archive")
def strict_number_parse(spark, d):
    """Published numbers with markers, commas and percent signs; anything else would stop the build."""
    return table(spark, d, "hcahps_archive").select(
        "record_id", to_number("patient_survey_star_rating", "int").alias("stars"), to_number("hcahps_linear_mean_value", "int").alias("score"),
        to_number("number_of_completed_surveys", "int").alias("surveys"), to_number("survey_response_rate_percent").alias("rate"),
    )


@query("""select source_release, replace(regexp_extract(replace(measure_name, '_', '-'), '^READM-30-(.+)-HRRP$', 1), '-', '_') as condition, count(*) as n,
count(*) filter (where number_of_readmissions = 'Too Few to Report') as suppressed from hrrp_snapshots group by all""")
def code_from_regex(spark, d):
    code = F.translate(F.regexp_extract(F.translate("measure_name", "_", "-"), "^READM-30-(.+)-HRRP$", 1), "-", "_")
    return table(spark, d, "hrrp_snapshots").groupBy("source_release", code.alias("condition")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("number_of_readmissions") == "Too Few to Report").alias("suppressed")
    )


@query("""select fiscal_year, case when excess_readmission_ratio is not null then 'scored' when footnote_code = '1' then 'too_few_cases' when footnote_code = '5' then 'not_available'
when footnote_code = '7' then 'no_cases' else 'unknown' end as status, count(*) as n from fct_readmissions where in_public_file group by all""")
def reason_classifier(spark, d):
    rows = table(spark, d, "fct_readmissions").where("in_public_file")
    return rows.groupBy("fiscal_year", score_status(F.col("excess_readmission_ratio"), F.col("footnote_code")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""select county_fips, state, replace(regexp_replace(regexp_replace(replace(upper(strip_accents(trim(county_name))), '.', ''), '^SAINT ', 'ST '),
' (CITY AND BOROUGH|CENSUS AREA|MUNICIPALITY|COUNTY|PARISH|BOROUGH)$', ''), ' ', '') as name_key from census_county""")
def clean_name_key(spark, d):
    return table(spark, d, "census_county").select("county_fips", "state", clean_county_name("county_name").alias("name_key"))


@query("""select fiscal_year, 'FY' || cast(year(fiscal_year_start) + 1 as varchar) as label, cast(substr(fiscal_year, 3) as int) as number, make_date(year(fiscal_year_start) + 1, 9, 30) as fiscal_year_end,
date_diff('day', fiscal_year_start, date '2025-10-01') as days, date_diff('month', fiscal_year_start, date '2025-10-01') as months, count(*) as n from fct_readmissions group by all""")
def date_parts(spark, d):
    start, ref = F.col("fiscal_year_start"), F.to_date(F.lit("2025-10-01"))
    return table(spark, d, "fct_readmissions").groupBy(
        "fiscal_year", F.concat(F.lit("FY"), (F.year(start) + 1).cast("string")).alias("label"), F.substring("fiscal_year", 3, 4).cast("int").alias("number"),
        F.make_date(F.year(start) + 1, F.lit(9), F.lit(30)).alias("fiscal_year_end"), F.datediff(ref, start).cast("bigint").alias("days"),
        R.months_between_starts(start, ref).cast("bigint").alias("months"),
    ).agg(F.count(F.lit(1)).alias("n"))


# Releases


@query("select hcahps_measure_id, source_release, count(*) as n from hcahps_archive where source_release = (select max(source_release) from hcahps_archive) group by all")
def latest_release_filter(spark, d):
    return R.latest_release(table(spark, d, "hcahps_archive"), "source_release").groupBy("hcahps_measure_id", "source_release").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select distinct source_release, start_date, end_date from hrrp_snapshots), k as (select start_date, end_date, max(source_release) as last, min(source_release) as first, count(*) as snapshots from p group by all)
select s.source_release, s.state, k.first as period_first_release, k.snapshots as period_snapshots, count(*) as n from hrrp_snapshots s
join k on s.start_date = k.start_date and s.end_date = k.end_date and s.source_release = k.last group by all""")
def latest_snapshot_per_period(spark, d):
    kept = R.latest_snapshot_per_period(table(spark, d, "hrrp_snapshots"), "source_release", "start_date", "end_date")
    return kept.groupBy("source_release", "state", F.col("_period_first_release").alias("period_first_release"), F.col("_period_snapshots").alias("period_snapshots")).agg(F.count(F.lit(1)).alias("n"))


@query("""select facility_id, name, city, since from (select facility_id, facility_name as name, city, cast(null as date) as since from hospital_info
union all select facility_id, facility_name, cast(null as varchar), snapshot_date from hospital_info_archive where facility_id is not null)""")
def renamed_columns_union(spark, d):
    """Releases with other columns under other names, as one table."""
    new = table(spark, d, "hospital_info").select("facility_id", "facility_name", "city")
    old = table(spark, d, "hospital_info_archive").where("facility_id is not null").select(F.col("facility_id").alias("provider_id"), F.col("facility_name").alias("hospital_name"), F.col("snapshot_date").alias("since"))
    both = R.union_releases([new, old])
    return both.select(R.either(both, "facility_id", "provider_id").alias("facility_id"), R.either(both, "facility_name", "hospital_name").alias("name"), "city", "since")


# Joins


@query("""with a as (select facility_id, fiscal_year, count(*) as results from (select distinct * from fct_readmissions) where in_public_file group by all),
b as (select facility_id, fiscal_year, max(payment_adjustment_factor) as factor from payment_adjustments group by all)
select facility_id, fiscal_year, results, factor, a.facility_id is not null as in_public, b.facility_id is not null as in_payment from a full join b using (facility_id, fiscal_year)""")
def full_outer_sources(spark, d):
    keys = ["facility_id", "fiscal_year"]
    a = Q.facts(spark, d).where("in_public_file").groupBy(*keys).agg(F.count(F.lit(1)).alias("results"))
    b = table(spark, d, "payment_adjustments").groupBy(*keys).agg(F.max("payment_adjustment_factor").alias("factor"))
    return R.outer_sources(a, b, keys, "in_public", "in_payment")


@query("with " + Q.SURVEY_SQL + "," + Q.YEARS_SQL + " select * from years")
def asof_latest_window(spark, d):
    return Q.years(spark, d).select("fiscal_year", "fiscal_year_start", "survey_start", "survey_end", "is_latest_fiscal_year")


@query("""select p.event_id, p.user_id, p.ts, e.ts as error_ts from (select * from events where event_type = 'purchase') p
asof left join (select user_id, ts from events where event_type = 'error') e on p.user_id = e.user_id and p.ts >= e.ts""")
def asof_by_key(spark, d):
    """For each purchase the user's last error at or before it; one shuffle by user, no pairs."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"))
    return R.asof_keyed(left, right, ["user_id"], "ts", "error_ts", [])


@query("""with y as (select distinct facility_id, fiscal_year, fiscal_year_start from fct_readmissions), h as (
select case when length(regexp_replace(facility_id, '\\s', '', 'g')) < 6 then lpad(upper(regexp_replace(facility_id, '\\s', '', 'g')), 6, '0') else upper(regexp_replace(facility_id, '\\s', '', 'g')) end as facility_id,
snapshot_date, max(upper(hospital_overall_rating)) as rating from hospital_info_archive group by all)
select y.facility_id, y.fiscal_year, h.snapshot_date, h.rating from y left join h using (facility_id)
qualify row_number() over (partition by y.facility_id, y.fiscal_year order by h.snapshot_date >= y.fiscal_year_start desc, abs(h.snapshot_date - y.fiscal_year_start)) = 1""")
def nearest_snapshot(spark, d):
    years = table(spark, d, "fct_readmissions").select("facility_id", "fiscal_year", "fiscal_year_start").distinct()
    archive = table(spark, d, "hospital_info_archive").groupBy(facility_number("facility_id").alias("facility_id"), "snapshot_date").agg(F.max(F.upper("hospital_overall_rating")).alias("rating"))
    return R.nearest_snapshot(years, archive, ["facility_id"], "fiscal_year_start", "snapshot_date", ["rating"]).select("facility_id", "fiscal_year", "snapshot_date", "rating")


_KEY = """replace(regexp_replace(regexp_replace(regexp_replace(upper(strip_accents(trim({0}))), '[.''’]', '', 'g'), '^SAINT ', 'ST '), ' (CITY AND BOROUGH|CENSUS AREA|MUNICIPALITY|COUNTY|PARISH|BOROUGH)$', ''), ' ', '')"""


@query(f"""with c as (select state, {_KEY.format('county_name')} as k, count(*) as n, any_value(county_fips) as county_fips from census_county group by all having count(*) = 1)
select h.facility_id, h.state, c.county_fips, count(*) as n from hospital_info h left join c on c.state = h.state and c.k = {_KEY.format('h.county_name')} group by all""")
def unique_match_join(spark, d):
    left = table(spark, d, "hospital_info").select("facility_id", "state", clean_county_name("county_name").alias("k"))
    right = table(spark, d, "census_county").select("state", clean_county_name("county_name").alias("k"), "county_fips")
    return R.unique_match(left, right, ["state", "k"], "county_fips").groupBy("facility_id", "state", "county_fips").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, s_suppkey, same_nation, s_acctbal from (select c.c_custkey, s.s_suppkey, c.c_nationkey = s.s_nationkey as same_nation, s.s_acctbal,
row_number() over (partition by c.c_custkey order by c.c_nationkey = s.s_nationkey desc, s.s_acctbal desc, s.s_suppkey) as r
from customer c join nation n on n.n_nationkey = c.c_nationkey join nation m on m.n_regionkey = n.n_regionkey join supplier s on s.s_nationkey = m.n_nationkey) where r = 1""")
def best_candidate_join(spark, d):
    """Each customer's best supplier of its region: of its nation before others, then by balance. Candidates are reduced to the best of
    each nation before customers meet them, so no customer is joined with all suppliers of a region."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    best_of = R.top_rows(supplier, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")])
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    own = customers.join(best_of, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    region = best_of.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    region = R.top_rows(region, ["n_regionkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")]).select("n_regionkey", F.col("s_suppkey").alias("__s"), F.col("s_acctbal").alias("__b"))
    both = own.join(region, "n_regionkey", "left").where(F.coalesce("s_suppkey", "__s").isNotNull())
    return both.select("c_custkey", F.coalesce("s_suppkey", "__s").alias("s_suppkey"), F.col("s_suppkey").isNotNull().alias("same_nation"), F.when(F.col("s_suppkey").isNotNull(), F.col("s_acctbal")).otherwise(F.col("__b")).alias("s_acctbal"))


@query(f"""with c as (select distinct state, county_fips, {_KEY.format('county_name')} as k from census_county), s as (select state, min(county_fips) as single from c group by state having count(*) = 1),
l as (select h.facility_id, h.state, nullif(h.name_county_fips, '') as given, min(c.county_fips) as named, min(s.single) as single
from hospital_info h left join c on c.state = h.state and c.k = {_KEY.format('h.county_name')} left join s on s.state = h.state group by all)
select facility_id, case when named is not null and named = given then 'agrees' when named is not null then 'by_name' when given is not null then 'given' when single is not null then 'single_county' else 'unmatched' end as method,
case when named is not null then named when given is not null then given else single end as county_fips, case when named is null or given is null then null else named <> given end as disagrees from l""")
def ladder_link_method(spark, d):
    c = table(spark, d, "census_county").select("state", "county_fips", clean_county_name("county_name").alias("k")).distinct()
    single = c.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("county_fips").alias("single")).where("n = 1").drop("n")
    h = table(spark, d, "hospital_info").select("facility_id", "state", F.nullif("name_county_fips", F.lit("")).alias("given"), clean_county_name("county_name").alias("k"))
    named = c.groupBy("state", "k").agg(F.min("county_fips").alias("named"))
    l = h.join(named, ["state", "k"], "left").join(single, "state", "left").groupBy("facility_id", "state", "given").agg(F.min("named").alias("named"), F.min("single").alias("single"))
    n, g = F.col("named"), F.col("given")
    method = R.ladder([(n == g, "agrees"), (n.isNotNull(), "by_name"), (g.isNotNull(), "given"), (F.col("single").isNotNull(), "single_county")], "unmatched")
    return l.select("facility_id", method.alias("method"), F.coalesce("named", "given", "single").alias("county_fips"), R.differs(n, g).alias("disagrees"))


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_in(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(big, "c_custkey", "left_semi")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_not_in(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("select facility_id, fiscal_year, count(*) as n from ml_penalty_features where (facility_id, fiscal_year) in (select (facility_id, fiscal_year) from fct_readmissions where counts_toward_penalty) group by all")
def tuple_in(spark, d):
    keys = ["facility_id", "fiscal_year"]
    counted = table(spark, d, "fct_readmissions").where("counts_toward_penalty").select(*keys)
    return table(spark, d, "ml_penalty_features").join(counted, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_custkey in (select c_custkey from customer where c_acctbal < 0) as of_debtor from orders where o_orderstatus = 'P'")
def in_as_column(spark, d):
    """IN as a projected boolean: a left join with distinct keys."""
    debtors = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("of_debtor")).distinct()
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").join(debtors, "o_custkey", "left").select("o_orderkey", F.coalesce("of_debtor", F.lit(False)).alias("of_debtor"))


@query("with " + Q.PAYMENTS_SQL + """ select p.facility_id, p.fiscal_year, p.payment_reduction_pct, e.payment_reduction_pct as earlier_pct from payments p
left join payments e on e.facility_id = p.facility_id and cast(substr(e.fiscal_year, 3) as int) + 3 = cast(substr(p.fiscal_year, 3) as int)""")
def lag_self_join(spark, d):
    paid = Q.payments(spark, d).select("facility_id", "fiscal_year", "payment_reduction_pct")
    past = R.shifted(paid.withColumnRenamed("payment_reduction_pct", "earlier_pct"), "fiscal_year", 3, lambda c: F.substring(c, 3, 4).cast("int"), lambda c: F.concat(F.lit("FY"), c.cast("string")))
    return paid.join(past, ["facility_id", "fiscal_year"], "left")


@query("""with k as (select old_facility_id as facility_id from ccn_changes union select new_facility_id from ccn_changes union select facility_id from hospital_info union select facility_id from payment_adjustments)
select k.facility_id, h.state, p.years, h.facility_id is not null as has_profile, coalesce(p.facility_id is not null, false) as in_payment from k
left join (select facility_id, max(state) as state from hospital_info group by all) h using (facility_id) left join (select facility_id, count(distinct fiscal_year) as years from payment_adjustments group by all) p using (facility_id)
where k.facility_id is not null""")
def key_union_dimension(spark, d):
    key = "facility_id"
    changes, info, paid = table(spark, d, "ccn_changes"), table(spark, d, "hospital_info"), table(spark, d, "payment_adjustments")
    everyone = R.key_union([changes.select(F.col("old_facility_id").alias(key)), changes.select(F.col("new_facility_id").alias(key)), info, paid], key).where(F.col(key).isNotNull())
    h = info.groupBy(key).agg(F.max("state").alias("state"), F.lit(True).alias("has_profile"))
    p = paid.groupBy(key).agg(F.count_distinct("fiscal_year").alias("years"), F.lit(True).alias("in_payment"))
    whole = everyone.join(h, key, "left").join(p, key, "left")
    return whole.select(key, "state", "years", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_profile", "in_payment")])


@query("""(select facility_id, 'left' as side from (select facility_id from fct_readmissions where fiscal_year = 'FY2020' except select facility_id from fct_readmissions where fiscal_year = 'FY2026'))
union all (select facility_id, 'right' from (select facility_id from fct_readmissions where fiscal_year = 'FY2026' except select facility_id from fct_readmissions where fiscal_year = 'FY2020'))""")
def symmetric_difference(spark, d):
    of = lambda y: table(spark, d, "fct_readmissions").where(F.col("fiscal_year") == y).select("facility_id")
    return R.symmetric_difference(of("FY2020"), of("FY2026"))


# Aggregates and reshaping


@query("with " + Q.SURVEY_SQL + "," + Q.WINDOW_SQL + " select * from by_window")
def pivot_survey_scores(spark, d):
    return Q.survey_by_window(spark, d)


@query("""select facility_id, fiscal_year, condition, name, value from (select facility_id, fiscal_year, condition, unnest(['predicted', 'expected', 'ratio']) as name,
unnest([predicted_readmission_rate, expected_readmission_rate, excess_readmission_ratio]) as value from (select distinct facility_id, fiscal_year, condition, predicted_readmission_rate, expected_readmission_rate, excess_readmission_ratio from fct_readmissions)) where value is not null""")
def unpivot_rates(spark, d):
    columns = {"predicted": "predicted_readmission_rate", "expected": "expected_readmission_rate", "ratio": "excess_readmission_ratio"}
    rows = table(spark, d, "fct_readmissions").select("facility_id", "fiscal_year", "condition", *columns.values()).distinct()
    return R.unpivoted(rows, ["facility_id", "fiscal_year", "condition"], "name", {n: {"value": F.col(c)} for n, c in columns.items()}, "value")


@query("""select fiscal_year, count(*) as n, count(excess_readmission_ratio) as scored, count(*) filter (where counts_toward_penalty) as counting, cast(sum(discharges) filter (where in_payment_file) as bigint) as discharges,
max(excess_readmission_ratio) filter (where condition = 'HF') as worst_hf, round(sum(penalty_contribution) filter (where counts_toward_penalty), 4) as contribution,
round(least(sum(penalty_contribution) filter (where counts_toward_penalty), 3), 4) as capped from (select distinct * from fct_readmissions) group by all""")
def filtered_aggregates(spark, d):
    counting = F.when(F.col("counts_toward_penalty"), F.col("penalty_contribution"))
    return Q.facts(spark, d).groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("n"), F.count("excess_readmission_ratio").alias("scored"), F.count_if("counts_toward_penalty").alias("counting"),
        F.sum(F.when(F.col("in_payment_file"), F.col("discharges"))).alias("discharges"), F.max(F.when(F.col("condition") == "HF", F.col("excess_readmission_ratio"))).alias("worst_hf"),
        F.round(F.sum(counting), 4).alias("contribution"), F.round(F.least(F.sum(counting), F.lit(3.0)), 4).alias("capped"),
    )


@query("""select fiscal_year, condition, count(distinct (discharges, readmissions)) as pairs, count(distinct facility_id) as hospitals, max(facility_id) as last_id,
arg_max(facility_id, (excess_readmission_ratio, facility_id)) as worst from fct_readmissions where excess_readmission_ratio is not null group by all having count(*) > 100""")
def struct_distinct_having(spark, d):
    rows = table(spark, d, "fct_readmissions").where("excess_readmission_ratio is not null")
    out = rows.groupBy("fiscal_year", "condition").agg(
        F.count_distinct(F.struct("discharges", "readmissions")).alias("pairs"), F.count_distinct("facility_id").alias("hospitals"), F.max("facility_id").alias("last_id"),
        F.max_by("facility_id", F.struct("excess_readmission_ratio", "facility_id")).alias("worst"), F.count(F.lit(1)).alias("n"),
    )
    return out.where("n > 100").drop("n")


@query("""select facility_id, fiscal_year, cast(sum(cast(excess_readmission_ratio as decimal(18,6)) * discharges) as double) / nullif(cast(sum(discharges) filter (where excess_readmission_ratio is not null) as double), 0) as weighted,
cast(sum(readmissions) as double) / nullif(cast(sum(discharges) as double), 0) as rate from (select distinct * from fct_readmissions) group by all""")
def weighted_ratio(spark, d):
    return Q.facts(spark, d).groupBy("facility_id", "fiscal_year").agg(
        R.weighted_mean("excess_readmission_ratio", "discharges").alias("weighted"), F.try_divide(F.sum("readmissions"), F.sum("discharges")).alias("rate")
    )


@query("""select facility_id, fiscal_year, condition, discharges, round(discharges / nullif(sum(discharges) over w, 0), 6) as share, count(*) over w as conditions
from (select distinct * from fct_readmissions) where discharges is not null window w as (partition by facility_id, fiscal_year)""")
def share_window(spark, d):
    rows = Q.facts(spark, d).where("discharges is not null").select("facility_id", "fiscal_year", "condition", "discharges")
    keys = ["facility_id", "fiscal_year"]
    return rows.withColumns({"share": F.round(R.share_of_total("discharges", keys), 6), "conditions": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


@query("""select doc_type, lang, count(*) as n, count(distinct text) as texts, round(avg(n_chars), 4) as mean_chars, round(avg(case when text is null then 1.0 else 0.0 end), 6) as missing from documents group by all""")
def text_report(spark, d):
    return table(spark, d, "documents").groupBy("doc_type", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg(F.col("text").isNull().cast("double")), 6).alias("missing")
    )


@query("""select facility_name, string_agg(distinct state, ',' order by state) as states, count(distinct facility_id) as hospitals from hospital_info group by all having count(distinct state) > 1""")
def shared_names(spark, d):
    """Names of hospitals in several states."""
    out = table(spark, d, "hospital_info").groupBy("facility_name").agg(F.sort_array(F.collect_set("state")).alias("__states"), F.count_distinct("facility_id").alias("hospitals"))
    return out.where(F.size("__states") > 1).select("facility_name", F.array_join("__states", ",").alias("states"), "hospitals")


# Windows, ranks and statistics


@query("""select facility_id, snapshot_date, hospital_type from (select facility_id, snapshot_date, max(hospital_type) as hospital_type from hospital_info_archive
where facility_id is not null group by all) qualify snapshot_date = max(snapshot_date) over (partition by facility_id)""")
def rows_at_max(spark, d):
    rows = table(spark, d, "hospital_info_archive").where("facility_id is not null").groupBy("facility_id", "snapshot_date").agg(F.max("hospital_type").alias("hospital_type"))
    return R.rows_at_max(rows, ["facility_id"], "snapshot_date")


@query("select fiscal_year, fiscal_year = (select max(fiscal_year) from payment_adjustments) as is_latest, count(*) as n from payment_adjustments group by all")
def latest_flag(spark, d):
    return R.latest_flag(table(spark, d, "payment_adjustments"), "fiscal_year", "is_latest").groupBy("fiscal_year", "is_latest").agg(F.count(F.lit(1)).alias("n"))


@query("with " + Q.PAYMENTS_SQL + """ select facility_id, fiscal_year, payment_reduction_pct, payment_reduction_pct >= quantile_cont(payment_reduction_pct, 0.75) over (partition by fiscal_year) as top_quarter from payments""")
def top_quarter_flag(spark, d):
    rows = Q.payments(spark, d).select("facility_id", "fiscal_year", "payment_reduction_pct")
    return O.top_share_flag(rows, ["fiscal_year"], "payment_reduction_pct", 0.75, "top_quarter")


@query("""with r as (select s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on s_suppkey = l_suppkey group by all)
select s_suppkey, revenue, round((rank() over (order by revenue) + (count(*) over (partition by revenue) - 1) / 2.0) / count(*) over (), 6) as pct from r""")
def rank_pct(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    rows = lines.join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "left_semi")
    return O.percent_ranked(rows, [], "revenue", "pct").withColumn("pct", F.round("pct", 6))


@query("""with q as (select fiscal_year, quantile_cont(payment_reduction_pct, [0.2, 0.4, 0.6, 0.8]) as e from p group by all),
b as (select p.fiscal_year, p.dual_proportion, 1 + len(list_filter(q.e, lambda x: p.payment_reduction_pct > x)) as quintile from p join q using (fiscal_year))
select fiscal_year, cast(quintile as int) as quintile, count(dual_proportion) as n, round(avg(dual_proportion), 6) as mean, round(stddev_samp(dual_proportion), 6) as sd, round(1.96 * stddev_samp(dual_proportion) / sqrt(count(dual_proportion)), 6) as half_width from b group by all""".replace("with q as", "with " + Q.PAYMENTS_SQL + ", p as (select * from payments where payment_reduction_pct is not null), q as"))
def quintile_profile(spark, d):
    rows = Q.payments(spark, d).where("payment_reduction_pct is not null").select("fiscal_year", "payment_reduction_pct", "dual_proportion")
    cut = O.bucketed(rows, ["fiscal_year"], "payment_reduction_pct", 5, "quintile")
    out = cut.groupBy("fiscal_year", "quintile").agg(*R.mean_interval("dual_proportion"))
    return out.select("fiscal_year", "quintile", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "half_width")])


@query("""with r as (select fiscal_year, payment_reduction_pct as a, dual_proportion as b from p where payment_reduction_pct is not null and dual_proportion is not null),
k as (select fiscal_year, rank() over (partition by fiscal_year order by a) + (count(*) over (partition by fiscal_year, a) - 1) / 2.0 as ra, rank() over (partition by fiscal_year order by b) + (count(*) over (partition by fiscal_year, b) - 1) / 2.0 as rb from r)
select fiscal_year, round(corr(ra, rb), 6) as rho, count(*) as n from k group by all""".replace("with r as", "with " + Q.PAYMENTS_SQL + ", p as (select * from payments), r as"))
def spearman_signal(spark, d):
    rows = Q.payments(spark, d).select("fiscal_year", "payment_reduction_pct", "dual_proportion")
    return O.spearman(rows, ["fiscal_year"], "payment_reduction_pct", "dual_proportion").withColumn("rho", F.round("rho", 6))


@query("""with r as (select fiscal_year, is_penalized as y, dual_proportion as s, rank() over (partition by fiscal_year order by dual_proportion) + (count(*) over (partition by fiscal_year, dual_proportion) - 1) / 2.0 as rk
from p where is_penalized is not null and dual_proportion is not null)
select fiscal_year, round((sum(rk) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2.0) / nullif(count(*) filter (where y) * count(*) filter (where not y), 0), 6) as auc, count(*) as n
from r group by all""".replace("with r as", "with " + Q.PAYMENTS_SQL + ", p as (select * from payments), r as"))
def auc_within_year(spark, d):
    rows = Q.payments(spark, d).select("fiscal_year", "is_penalized", "dual_proportion")
    return O.auc(rows, ["fiscal_year"], "is_penalized", "dual_proportion").select("fiscal_year", F.round("auc", 6).alias("auc"), "n")


@query("""select event_type, count(*) as n, round(avg(value), 4) as mean, min(value) as least, round(quantile_cont(value, 0.25), 4) as q1, round(median(value), 4) as q2, round(quantile_cont(value, 0.75), 4) as q3, max(value) as most
from events where value is not null group by all""")
def describe_values(spark, d):
    rows = table(spark, d, "events").where("value is not null").select("event_type", "value")
    plain = rows.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    edges = O.group_quantiles(rows, ["event_type"], "value", [0.25, 0.5, 0.75])
    return plain.join(edges, "event_type").select("event_type", "n", "mean", "least", *[F.round(f"q{i}", 4).alias(f"q{i + 1}") for i in range(3)], "most")


@query("""select cast(floor(value / 50) as bigint) as bin, count(*) as n, min(value) as least, max(value) as most from events where value is not null group by all""")
def histogram(spark, d):
    rows = table(spark, d, "events").where("value is not null")
    return rows.groupBy(F.floor(F.col("value") / 50).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""with days as (select cast(unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval 1 day)) as date) as date_day)
select date_day, count(o_orderkey) as orders from days left join orders on cast(o_orderdate as date) = date_day group by all""")
def calendar_spine(spark, d):
    orders = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date_day")).agg(F.count(F.lit(1)).alias("orders"))
    return R.calendar(spark, "1995-01-01", "2002-01-01").join(orders, "date_day", "left").select("date_day", F.coalesce("orders", F.lit(0)).alias("orders"))


# Order and limits


@query("with " + Q.PAYMENTS_SQL + "," + Q.HOSPITALS_SQL + """ select state, round(avg(payment_reduction_pct), 6) as pct from payments left join hospitals using (facility_id) where fiscal_year = (select max(fiscal_year) from payments) and state is not null
group by all order by pct desc nulls last, state limit 10""")
def top_states(spark, d):
    """A ranking: rows without a key are left out before it is cut."""
    rows = R.latest_release(Q.payments(spark, d), "fiscal_year").join(Q.hospitals(spark, d).select("facility_id", "state"), "facility_id", "left")
    return R.ordered(rows.groupBy("state").agg(F.round(F.avg("payment_reduction_pct"), 6).alias("pct")).dropna(subset=["state"]), ["-pct", "state"], 10)


@query("""with t as (select l_suppkey from lineitem group by all order by round(sum(l_extendedprice), 2) desc, l_suppkey limit 20) select l_suppkey, l_returnflag, count(*) as n, sum(l_quantity) as quantity
from lineitem where l_suppkey in (select l_suppkey from t) group by all""")
def top20_members(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    return R.top_n_members(lines, "l_suppkey", F.round(F.sum("l_extendedprice"), 2), 20).groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 25")
def largest_by_absolute_value(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(25)


# Checks


@query("""select 'key' as "check", count(*) as failures from (select facility_id from payment_adjustments group by facility_id, fiscal_year having count(*) > 1)
union all select 'factor_range', count(*) from payment_adjustments where payment_adjustment_factor < 0.97 or payment_adjustment_factor > 1
union all select 'peer_group_known', count(*) from payment_adjustments where peer_group is null
union all select 'peer_group_values', count(*) from payment_adjustments where peer_group is not null and peer_group not in (1, 2, 3)
union all select 'rule', count(*) from fct_readmissions where not (not counts_toward_penalty or excess_readmission_ratio > 1)
union all select 'id_form', count(*) from hrrp_snapshots where not regexp_full_match(facility_id, '[0-9A-Z]{6}')
union all select 'parent', count(*) from payment_adjustments where facility_id is not null and facility_id not in (select facility_id from hospital_info where facility_id is not null)
union all select 'identical_copies', count(*) from (select facility_id from (select distinct facility_id, fiscal_year, payment_adjustment_factor, peer_group from payment_adjustments) group by facility_id, fiscal_year having count(*) > 1)""")
def dq_summary(spark, d):
    paid, facts, snaps = table(spark, d, "payment_adjustments"), table(spark, d, "fct_readmissions"), table(spark, d, "hrrp_snapshots")
    return checks.summary(
        spark,
        {
            "key": checks.unique(paid, "facility_id", "fiscal_year"),
            "factor_range": checks.accepted_range(paid, "payment_adjustment_factor", 0.97, 1),
            "peer_group_known": checks.not_null(paid, "peer_group"),
            "peer_group_values": checks.accepted_values(paid, "peer_group", [1, 2, 3]),
            "rule": checks.expression_is_true(facts, ~F.col("counts_toward_penalty") | (F.col("excess_readmission_ratio") > 1)),
            "id_form": checks.full_match(snaps, "facility_id", "[0-9A-Z]{6}"),
            "parent": checks.relationship(paid, "facility_id", table(spark, d, "hospital_info"), "facility_id"),
            "identical_copies": checks.copies_identical(paid, ["facility_id", "fiscal_year"], ["payment_adjustment_factor", "peer_group"]),
        },
    )


@query("""select facility_id, hcahps_measure_id, start_date, count(*) as rows from hcahps_archive group by all having count(*) > 1""")
def dq_duplicates(spark, d):
    return checks.unique(table(spark, d, "hcahps_archive"), "facility_id", "hcahps_measure_id", "start_date")


@query("""select 'results' as name, (select count(*) from fct_readmissions) as left_rows, (select count(*) from (select distinct * from fct_readmissions)) as right_rows
union all select 'survey', (select count(*) from hcahps_archive), (select count(*) from (select distinct facility_id, hcahps_measure_id, start_date, end_date, source_release from hcahps_archive))""")
def dq_row_counts(spark, d):
    facts, survey = table(spark, d, "fct_readmissions"), table(spark, d, "hcahps_archive")
    return checks.same_counts({"results": (facts, facts.distinct()), "survey": (survey, survey.select("facility_id", "hcahps_measure_id", "start_date", "end_date", "source_release").distinct())})


@query("""select facility_id, fiscal_year, condition, round(penalty_contribution, 6) as published, round(drg_payment_ratio * (payment_excess_readmission_ratio - peer_group_median_err), 6) as computed
from (select distinct * from fct_readmissions) where in_payment_file and abs(penalty_contribution - drg_payment_ratio * (payment_excess_readmission_ratio - peer_group_median_err)) > 0.001""")
def dq_recompute(spark, d):
    computed = F.col("drg_payment_ratio") * (F.col("payment_excess_readmission_ratio") - F.col("peer_group_median_err"))
    bad = checks.recomputes(Q.facts(spark, d).where("in_payment_file"), F.col("penalty_contribution"), computed, 0.001)
    return bad.select("facility_id", "fiscal_year", "condition", F.round("penalty_contribution", 6).alias("published"), F.round(computed, 6).alias("computed"))


# Metrics


def _layer(spark: SparkSession, d: str):
    return hospital_layer(Q.marts(spark, d))


@query(Q.MARTS_SQL + """ select fiscal_year, cast(sum(case when in_payment_file then 1 else 0 end) as bigint) as hospitals_in_payment_file, cast(sum(case when is_penalized then 1 else 0 end) as bigint) as penalized_hospitals,
round(sum(case when is_penalized then 1 else 0 end) / nullif(sum(case when in_payment_file then 1 else 0 end), 0), 6) as share_penalized, round(sum(payment_reduction_pct) / nullif(sum(case when in_payment_file then 1 else 0 end), 0), 6) as avg_payment_reduction_pct,
round(sum(payment_reduction_pct) / nullif(sum(case when is_penalized then 1 else 0 end), 0), 6) as avg_payment_reduction_among_penalized_pct, max(payment_reduction_pct) as max_payment_reduction_pct,
cast(sum(case when payment_reduction_pct >= 3 then 1 else 0 end) as bigint) as hospitals_at_max_penalty, round(avg(recommend_score), 6) as avg_recommend_score, round(avg(overall_rating_score), 6) as avg_overall_rating_score from hospital_years group by all""")
def metric_hospital_years(spark, d):
    counts = ["hospitals_in_payment_file", "penalized_hospitals", "hospitals_at_max_penalty"]
    figures = ["share_penalized", "avg_payment_reduction_pct", "avg_payment_reduction_among_penalized_pct", "max_payment_reduction_pct", "avg_recommend_score", "avg_overall_rating_score"]
    out = _layer(spark, d).query([*counts, *figures], ["fiscal_year"])
    return out.select("fiscal_year", *counts, *[F.round(c, 6).alias(c) for c in figures])


@query(Q.MARTS_SQL + """ select fiscal_year, condition as readmission_result__condition, count(excess_readmission_ratio) as scored_results, round(sum(excess_readmission_ratio) / nullif(count(excess_readmission_ratio), 0), 6) as avg_excess_readmission_ratio,
cast(sum(case when excess_readmission_ratio > 1 then 1 else 0 end) as bigint) as results_worse_than_expected, round(sum(case when excess_readmission_ratio > 1 then 1 else 0 end) / nullif(count(excess_readmission_ratio), 0), 6) as share_results_worse_than_expected,
cast(sum(case when counts_toward_penalty then 1 else 0 end) as bigint) as results_counting_toward_penalty, cast(sum(eligible_discharges) as bigint) as eligible_discharges from facts group by all""")
def metric_by_condition(spark, d):
    names = ["scored_results", "avg_excess_readmission_ratio", "results_worse_than_expected", "share_results_worse_than_expected", "results_counting_toward_penalty", "eligible_discharges"]
    out = _layer(spark, d).query(names, ["fiscal_year", "readmission_result__condition"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_excess_readmission_ratio", "share_results_worse_than_expected")})


@query(Q.MARTS_SQL + """ , a as (select h.state as s, round(sum(case when is_penalized then 1 else 0 end) / nullif(sum(case when in_payment_file then 1 else 0 end), 0), 6) as share_penalized from hospital_years y left join hospitals h using (facility_id) where fiscal_year >= 'FY2023' group by all),
b as (select h.state as s, count(excess_readmission_ratio) as scored_results from facts f left join hospitals h using (facility_id) where fiscal_year >= 'FY2023' group by all)
select coalesce(a.s, b.s) as hospital__state, share_penalized, scored_results from a full join b on a.s is not distinct from b.s""")
def metric_multi_fact(spark, d):
    """Metrics of two facts by a shared dimension."""
    out = _layer(spark, d).query(["share_penalized", "scored_results"], ["hospital__state"], [Filter("fiscal_year", ">=", "FY2023")])
    return out.withColumn("share_penalized", F.round("share_penalized", 6))


@query(Q.MARTS_SQL + """ select c.state as hospital__county__state_name, y.fiscal_year, round(sum(payment_reduction_pct) / nullif(sum(case when in_payment_file then 1 else 0 end), 0), 6) as avg_payment_reduction_pct
from hospital_years y left join hospitals h using (facility_id) left join census_county c on c.county_fips = h.county_fips where h.ownership <> 'State' group by all""")
def metric_multi_hop(spark, d):
    """A dimension two joins away, and a filter on one that is one join away."""
    out = _layer(spark, d).query(["avg_payment_reduction_pct"], ["hospital__county__state_name", "fiscal_year"], [Filter("hospital__ownership", "!=", "State")])
    return out.withColumn("avg_payment_reduction_pct", F.round("avg_payment_reduction_pct", 6))


@query(Q.MARTS_SQL + """ select h.state as hospital__state, h.ownership as hospital__ownership from (select distinct facility_id from hospital_years) y join hospitals h using (facility_id) where h.state is not null and h.ownership is not null group by all""")
def metric_dimension_values(spark, d):
    return _layer(spark, d).dimension_values(["hospital__state", "hospital__ownership"])


@query(Q.MARTS_SQL + """ , m as (select fiscal_year, sum(case when in_payment_file then 1 else 0 end) as a, sum(case when is_penalized then 1 else 0 end) as b, max(payment_reduction_pct) as c, sum(case when payment_reduction_pct >= 3 then 1 else 0 end) as e, sum(payment_reduction_pct) as t,
avg(recommend_score) as s1, avg(overall_rating_score) as s2, avg(care_transition_score) as s3, avg(discharge_information_score) as s4 from hospital_years group by all),
r as (select fiscal_year, count(excess_readmission_ratio) as n, sum(excess_readmission_ratio) as x, sum(case when excess_readmission_ratio > 1 then 1 else 0 end) as w, sum(case when counts_toward_penalty then 1 else 0 end) as k, sum(eligible_discharges) as g from facts group by all)
select metric, fiscal_year, round(v, 6) as expected_value from (
select fiscal_year, unnest(['hospitals_in_payment_file', 'penalized_hospitals', 'share_penalized', 'avg_payment_reduction_pct', 'avg_payment_reduction_among_penalized_pct', 'max_payment_reduction_pct', 'hospitals_at_max_penalty', 'avg_recommend_score', 'avg_overall_rating_score', 'avg_care_transition_score', 'avg_discharge_information_score']) as metric,
unnest([cast(a as double), b, b / nullif(a, 0), t / nullif(a, 0), t / nullif(b, 0), c, e, s1, s2, s3, s4]) as v from m
union all select fiscal_year, unnest(['scored_results', 'avg_excess_readmission_ratio', 'results_worse_than_expected', 'share_results_worse_than_expected', 'results_counting_toward_penalty', 'eligible_discharges']), unnest([cast(n as double), x / nullif(n, 0), w, w / nullif(n, 0), k, g]) from r)""")
def metric_checks_long(spark, d):
    """Every offered metric by fiscal year, long, for reconciliation in a reporting tool."""
    return _layer(spark, d).metric_checks("fiscal_year").withColumn("expected_value", F.round("expected_value", 6))


@query(Q.MARTS_SQL + """ select h.state as hospital__state, round(sum(case when is_penalized then 1 else 0 end) / nullif(sum(case when in_payment_file then 1 else 0 end), 0), 6) as share_penalized from hospital_years y left join hospitals h using (facility_id)
where fiscal_year = 'FY2026' and h.state is not null group by all order by share_penalized desc nulls last, hospital__state limit 5""")
def plan_ranked(spark, d):
    """A plan without a year, ranked: the latest year is taken, rows without a key are left out, then it is cut."""
    agent = Agent(_layer(spark, d), Scripted([]))
    plan, _ = agent.prepare(Plan(("share_penalized",), ("hospital__state",), (), "highest_first", 5))
    return agent.frame(plan).withColumn("share_penalized", F.round("share_penalized", 6))


@query(Q.MARTS_SQL + """ select fiscal_year, is_penalized as hospital_year__is_penalized, round(avg(overall_rating_score), 6) as avg_overall_rating_score from hospital_years where fiscal_year >= 'FY2024' and is_penalized is not null group by all""")
def plan_comparison(spark, d):
    """Two equal filters on a dimension are a comparison, a range of years a row each."""
    agent = Agent(_layer(spark, d), Scripted([]))
    filters = (Filter("hospital_year__is_penalized", "=", "yes"), Filter("hospital_year__is_penalized", "=", "no"), Filter("fiscal_year", ">=", "fy2024"))
    plan, _ = agent.prepare(Plan(("avg_overall_rating_score",), (), filters))
    return agent.frame(plan).withColumn("avg_overall_rating_score", F.round("avg_overall_rating_score", 6))


LINES = Model("lines", "lineitem", "line", joins={"order": "l_orderkey"}, dimensions={"flag": "l_returnflag"})
ORDERS = Model("orders", "orders", "order", key="o_orderkey", joins={"customer": "o_custkey"}, dimensions={"year": "year(o_orderdate)", "priority": "o_orderpriority"})
CUSTOMERS = Model("customers", "customer", "customer", key="c_custkey", joins={"nation": "c_nationkey"}, dimensions={"segment": "c_mktsegment"})
NATIONS = Model("nations", "nation", "nation", key="n_nationkey", joins={"region": "n_regionkey"}, dimensions={"name": "n_name"})
REGIONS = Model("regions", "region", "region", key="r_regionkey", dimensions={"name": "r_name"})
LINE_METRICS = [
    Metric("lines", "Lines", Measure("lines", "count", "l_orderkey")),
    Metric("returned", "Returned lines", Measure("lines", "sum", "case when l_returnflag = 'R' then 1 else 0 end")),
    Metric("share_returned", "Share of lines returned", ratio=("returned", "lines")),
    Metric("revenue", "Revenue", Measure("lines", "sum", "l_extendedprice * (1 - l_discount)")),
]


@query("""select n_name as order__customer__nation__name, round(sum(case when l_returnflag = 'R' then 1 else 0 end) / nullif(count(l_orderkey), 0), 6) as share_returned, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey where year(o_orderdate) = 1998 group by all order by share_returned desc nulls last limit 5""")
def metric_returned_by_nation(spark, d):
    """Five nations with the highest share of returned lines in a year: a fact, three joins away from its dimension."""
    layer = MetricLayer([LINES, ORDERS, CUSTOMERS, NATIONS, REGIONS], LINE_METRICS, lambda name: table(spark, d, name))
    out = layer.query(["share_returned", "revenue"], ["order__customer__nation__name"], [Filter("order__year", "=", 1998)], ["-share_returned"], 5)
    return out.withColumns({"share_returned": F.round("share_returned", 6), "revenue": F.round("revenue", 2)})


@query("from (pivot (select distinct * from fct_readmissions) on fiscal_year using round(avg(excess_readmission_ratio), 6) group by condition)")
def condition_year_matrix(spark, d):
    """A column for every fiscal year there is."""
    return export.matrix(Q.facts(spark, d), "condition", "fiscal_year", F.round(F.avg("excess_readmission_ratio"), 6))


@query("with " + Q.PAYMENTS_SQL + """, r as (select fiscal_year, payment_reduction_pct as predicted, dual_proportion as actual, is_penalized,
(rank() over (partition by fiscal_year order by payment_reduction_pct) + (count(*) over (partition by fiscal_year, payment_reduction_pct) - 1) / 2.0) / count(*) over (partition by fiscal_year) > 0.75 as is_flagged from payments where payment_reduction_pct is not null)
select fiscal_year, count(*) filter (where is_flagged) as flagged, round(cast(count(*) filter (where is_flagged and is_penalized) as double) / nullif(count(*) filter (where is_flagged), 0), 6) as flag_precision, round(avg(predicted), 6) as avg_predicted, round(avg(actual), 6) as avg_actual from r group by all""")
def model_measures(spark, d):
    """Measures of a report on scored rows: flagged, precision of the flag, mean prediction and figure."""
    rows = Q.payments(spark, d).where("payment_reduction_pct is not null")
    risk = export.model_risk(rows, "payment_reduction_pct", "dual_proportion").join(rows.select("facility_id", "fiscal_year", "is_penalized"), ["facility_id", "fiscal_year"])
    out = export.model_measures(risk, "is_penalized")
    return out.select("fiscal_year", "flagged", *[F.round(c, 6).alias(c) for c in ("flag_precision", "avg_predicted", "avg_actual")])


@query("with " + Q.FACTS_SQL + "," + Q.HOSPITALS_SQL + """ select 'dim_county' as name, count(*) as n from census_county where state = 'TX' union all select 'dim_hospital', count(*) from hospitals where county_fips in (select county_fips from census_county where state = 'TX')
union all select 'dim_fiscal_year', count(*) from (select distinct fiscal_year from fct_readmissions) where fiscal_year >= 'FY2024'
union all select 'fct_readmissions', count(*) from facts where fiscal_year >= 'FY2024' and facility_id in (select facility_id from hospitals where county_fips in (select county_fips from census_county where state = 'TX'))""")
def filter_propagation(spark, d):
    """A county and a year selected in a report: what is left of each table."""
    tables = {"dim_county": table(spark, d, "census_county"), "dim_hospital": Q.hospitals(spark, d), "dim_fiscal_year": table(spark, d, "fct_readmissions").select("fiscal_year").distinct(), "fct_readmissions": Q.facts(spark, d)}
    shown = export.propagated(tables, {"dim_county": F.col("state") == "TX", "dim_fiscal_year": F.col("fiscal_year") >= "FY2024"})
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in shown.items()]
    return reduce(DataFrame.unionByName, counts)


@query("""with a as (select fiscal_year, condition, cast(count(*) as double) as expected from fct_readmissions group by all), b as (select fiscal_year, condition, cast(count(*) as double) as found from (select distinct * from fct_readmissions) group by all)
select fiscal_year, condition, expected, found from a full join b using (fiscal_year, condition) where abs(coalesce(expected, 0) - coalesce(found, 0)) > 1e-6 * greatest(1, abs(coalesce(expected, 0)))""")
def reconciliation_mismatches(spark, d):
    keys = ["fiscal_year", "condition"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name))
    return export.mismatches(count(table(spark, d, "fct_readmissions"), "expected"), count(Q.facts(spark, d), "found"), keys, "expected", "found")


@query("with " + Q.PAYMENTS_SQL + """, r as (select fiscal_year, facility_id, payment_reduction_pct as predicted, dual_proportion as actual,
round((rank() over (partition by fiscal_year order by payment_reduction_pct) + (count(*) over (partition by fiscal_year, payment_reduction_pct) - 1) / 2.0) / count(*) over (partition by fiscal_year), 6) as predicted_rank from payments where payment_reduction_pct is not null)
select *, predicted_rank > 0.75 as is_flagged from r""")
def rank_flags(spark, d):
    """A score's rank within its year, and the flag of the top quarter."""
    rows = Q.payments(spark, d).where("payment_reduction_pct is not null")
    out = export.model_risk(rows, "payment_reduction_pct", "dual_proportion").withColumn("predicted_rank", F.round("predicted_rank", 6))
    return out.withColumn("is_flagged", F.col("predicted_rank") > 0.75)


@query("""select county_fips, expected, found from (select e.county_fips, e.expected, c.state as found from (values ('01001', 'AL'), ('02001', 'AK'), ('99999', 'ZZ'), ('03001', 'XX')) e(county_fips, expected) left join census_county c using (county_fips))
where found is distinct from expected""")
def dq_golden(spark, d):
    return checks.golden(table(spark, d, "census_county"), "county_fips", "state", {"01001": "AL", "02001": "AK", "99999": "ZZ", "03001": "XX"})


@query("select condition, case condition when 'AMI' then 'Heart attack' when 'HF' then 'Heart failure' else condition end as label, count(*) as n from fct_readmissions group by all")
def labelled_codes(spark, d):
    label = export.labelled(F.col("condition"), {"AMI": "Heart attack", "HF": "Heart failure"})
    return table(spark, d, "fct_readmissions").groupBy("condition", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Models and streams, which SQL cannot say


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ml_penalty_features").distinct().where("payment_reduction_pct is not null").drop("split")
    year = F.substring("fiscal_year", 3, 4).cast("int")
    last = rows.agg(F.max("fiscal_year").alias("__last"))
    split = F.when(F.col("fiscal_year") == F.col("__last"), "test").when(year <= F.substring("__last", 3, 4).cast("int") - 3, "train").otherwise("overlap_unused")
    rows = rows.crossJoin(F.broadcast(last)).withColumn("split", split).drop("__last")
    rows = last_row(rows, ["facility_id", "fiscal_year"], [c for c in rows.columns if c not in ("facility_id", "fiscal_year")], ["payment_reduction_pct"])
    return O.top_share_flag(rows, ["fiscal_year"], "payment_reduction_pct", 0.75, "is_top_quarter_penalty")


FEATURES = ["eligible_discharges", "conditions_with_25_cases", "dual_proportion", "hospital_type", "ownership"]


@query()
def ridge_scores(spark, d):
    """Scores of a linear model for the latest year, fitted on years without shared patients."""
    from lodestack.ml.models import fit_ridge
    from lodestack.ml.roles import honest_split

    train, test = honest_split(_features(spark, d))
    return fit_ridge(train, FEATURES, "payment_reduction_pct").score(test).select("facility_id", "fiscal_year", "payment_reduction_pct", F.round("score", 6).alias("score"))


@query()
def tuned_ridge_scores(spark, d):
    """Scores for the latest year of the linear model whose penalty ranks best over five folds of the training years."""
    from lodestack.ml.models import fit_ridge
    from lodestack.ml.roles import honest_split
    from lodestack.ml.train import tune

    ensure_checkpoint_dir(spark)
    train, test = honest_split(_features(spark, d).checkpoint())
    params, auc = tune("ridge", train, FEATURES, "payment_reduction_pct")
    scored = fit_ridge(train, FEATURES, "payment_reduction_pct", **params).score(test)
    return scored.select("facility_id", "fiscal_year", "payment_reduction_pct", F.lit(params["alpha"]).alias("alpha"), F.lit(round(auc, 6)).alias("cv_auc"), F.round("score", 6).alias("score"))


@query()
def bootstrap_draws(spark, d):
    """Areas under the curve of the own share of dual patients, on resampled hospitals of the latest year."""
    from lodestack.ml.metrics import bootstrap

    test = _features(spark, d).where("split = 'test' and dual_proportion is not null")
    return bootstrap(test, ["dual_proportion"], "auc_top_quarter")


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def incremental_events(spark, d):
    """Files picked up by a stream that stops when there is nothing new, then aggregated."""
    import uuid

    from lodestack.streaming.incremental import append_new

    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([f for f in table(spark, d, "events").schema if f.name in ("event_type", "value")])
    append_new(spark, f"{d}/events*.parquet", schema, f"{at}/table", f"{at}/state").awaitTermination()
    rows = spark.read.parquet(f"{at}/table")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))



"""The governed metrics of hospital years and readmission results, over any tables of that shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestack.plans.semantic import Measure, Metric, MetricLayer, Model

YEARS = Model("fiscal_years", "dim_fiscal_year", "fiscal_year", key="fiscal_year", dimensions={"is_latest_fiscal_year": "is_latest_fiscal_year"})
HOSPITALS = Model(
    "hospitals",
    "dim_hospital",
    "hospital",
    key="facility_id",
    joins={"county": "county_fips"},
    dimensions={c: c for c in ("facility_name", "city", "state", "ownership", "hospital_type", "overall_star_rating", "is_hrrp_hospital")},
)
COUNTIES = Model("counties", "dim_county", "county", key="county_fips", dimensions={"county_name": "county_name", "state_name": "state_name"})
HOSPITAL_YEARS = Model(
    "hospital_years",
    "fct_hospital_year",
    "hospital_year",
    joins={"fiscal_year": "fiscal_year", "hospital": "facility_id"},
    dimensions={"peer_group": "peer_group", "is_penalized": "is_penalized"},
    shared={"fiscal_year": "fiscal_year"},
)
RESULTS = Model(
    "readmission_results",
    "fct_readmissions",
    "readmission_result",
    joins={"fiscal_year": "fiscal_year", "hospital": "facility_id"},
    dimensions={"condition": "condition", "score_status": "score_status"},
    shared={"fiscal_year": "fiscal_year"},
)


def _count_if(model: str, condition: str) -> Measure:
    return Measure(model, "sum", f"case when {condition} then 1 else 0 end")


def _simple(name: str, label: str, measure: Measure, hidden: bool = False, form: str = "count") -> Metric:
    return Metric(name, label, measure, hidden=hidden, form=form)


def _ratio(name: str, label: str, top: str, bottom: str, form: str = "percent") -> Metric:
    return Metric(name, label, ratio=(top, bottom), form=form)


HY, RR = HOSPITAL_YEARS.name, RESULTS.name
METRICS = [
    _simple("hospitals_in_payment_file", "Hospitals in the payment file", _count_if(HY, "in_payment_file")),
    _simple("penalized_hospitals", "Penalized hospitals", _count_if(HY, "is_penalized")),
    _ratio("share_penalized", "Share of hospitals penalized", "penalized_hospitals", "hospitals_in_payment_file", "share"),
    _ratio("avg_payment_reduction_pct", "Average payment reduction", "payment_reduction_pct_total", "hospitals_in_payment_file"),
    _ratio("avg_payment_reduction_among_penalized_pct", "Average payment reduction of penalized hospitals", "payment_reduction_pct_total", "penalized_hospitals"),
    _simple("max_payment_reduction_pct", "Largest payment reduction", Measure(HY, "max", "payment_reduction_pct"), form="percent"),
    _simple("hospitals_at_max_penalty", "Hospitals at the largest reduction", _count_if(HY, "payment_reduction_pct >= 3")),
    _simple("payment_reduction_pct_total", "Sum of payment reductions", Measure(HY, "sum", "payment_reduction_pct"), hidden=True, form="percent"),
    _simple("scored_results", "Scored results", Measure(RR, "count", "excess_readmission_ratio")),
    _ratio("avg_excess_readmission_ratio", "Average excess readmission ratio", "excess_readmission_ratio_total", "scored_results", "ratio"),
    _simple("excess_readmission_ratio_total", "Sum of ratios", Measure(RR, "sum", "excess_readmission_ratio"), hidden=True, form="ratio"),
    _simple("results_worse_than_expected", "Results worse than expected", _count_if(RR, "excess_readmission_ratio > 1")),
    _ratio("share_results_worse_than_expected", "Share of results worse than expected", "results_worse_than_expected", "scored_results", "share"),
    _simple("results_counting_toward_penalty", "Results that count", _count_if(RR, "counts_toward_penalty")),
    _simple("eligible_discharges", "Eligible discharges", Measure(RR, "sum", "eligible_discharges")),
    *(
        _simple(f"avg_{topic}_score", f"Average score: {topic.replace('_', ' ')}", Measure(HY, "average", f"{topic}_score"), form="score")
        for topic in ("recommend", "overall_rating", "care_transition", "discharge_information")
    ),
]


def hospital_layer(tables: Callable[[str], DataFrame]) -> MetricLayer:
    return MetricLayer([YEARS, HOSPITALS, COUNTIES, HOSPITAL_YEARS, RESULTS], METRICS, tables)

"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import canonical, language, packing, quantiles, splits, tokens
from lodestack.session import cut, spread, table

TOKENIZER = "byte_bpe_50k"
CAPACITY = 2048
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
TOLERANCE = 0.01
PROBABILITIES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.county_links(table(spark, folder, "hospital_info"), table(spark, folder, "census_county"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The county that each hospital's entry means, or ``unmatched``."""
    return _links(spark, folder).select("facility_id", F.coalesce("county_fips", F.lit("unmatched")).alias("county_fips"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the link's method, distance and number of candidates."""
    return _links(spark, folder).withColumn("candidates", F.size("candidates"))


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that match nothing, with how many hospitals wrote them."""
    lost = _links(spark, folder).where(F.col("county_fips").isNull())
    return lost.groupBy("state", "county_name", "method").agg(F.count(F.lit(1)).alias("hospitals"))


def _ratios(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.peer_ratios(table(spark, folder, "fct_readmissions"), table(spark, folder, "payment_adjustments"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups whose published median is not the median."""
    return quantiles.median_differences(cut(_ratios(spark, folder)), TOLERANCE).select("fiscal_year", "condition", "peer_group")


def p4_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the ratio per fiscal year, condition and peer group, from the states of all states' hospitals (the first two signs of their
    number) put together."""
    value, part = "excess_readmission_ratio", F.substring("facility_id", 1, 2).alias("__part")
    states = quantiles.quantile_state(_ratios(spark, folder).select(*quantiles.PEERS, part, value), ["__part", *quantiles.PEERS], value)
    out = quantiles.quantiles(quantiles.merge_states(states.drop("__part")), quantiles.PEERS, value, PROBABILITIES)
    return out.withColumn("quantile", F.round("quantile", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of connected hospital numbers whose rows lie in more than one split."""
    _, labels = splits.spanning_forest(table(spark, folder, "ccn_changes"), "old_facility_id", "new_facility_id")
    rows = table(spark, folder, "ml_penalty_features").select("facility_id", "split").where(F.col("facility_id").isNotNull())
    return splits.leaking_groups(splits.grouped_rows(rows, labels, "facility_id"), "split")


def p7_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The spanning forest of hospital numbers, by the round in which an edge was chosen."""
    return splits.spanning_forest(table(spark, folder, "ccn_changes"), "old_facility_id", "new_facility_id")[0]


def p7_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A new split of the hospital years, each connected group in one part."""
    rows = table(spark, folder, "ml_penalty_features").select("facility_id", "fiscal_year")
    return splits.assign_splits(rows, table(spark, folder, "ccn_changes"), "facility_id", "old_facility_id", "new_facility_id", SHARES)


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every text."""
    return tokens.encode_corpus(_texts(spark, folder), "doc_id", "text", tokens.vocabulary(TOKENIZER))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every text decoded from its ids."""
    ranks = tokens.vocabulary(TOKENIZER).replace(".json", ".tiktoken")
    return tokens.decode_corpus(p8_ids(spark, folder), "doc_id", tokens.token_bytes(spark, ranks))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.encode_corpus(_texts(spark, folder), "doc_id", "text", tokens.vocabulary(TOKENIZER), lengths=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of a text longer than the capacity, in its container."""
    return _packed(spark, folder).select("doc_id", "piece", F.col("start").alias("first_token"), F.col("size").alias("n_tokens"), "container_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.packing_report(_packed(spark, folder), CAPACITY)


def _model(spark: SparkSession, folder: str) -> tuple[DataFrame, language.Model]:
    documents = _texts(spark, folder, "lang")
    return documents, language.fit(documents, "doc_id", "text", "lang")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a missing or wrong label and mixed texts, a row per language."""
    documents, model = _model(spark, folder)
    return language.wrong_labels(documents, "doc_id", "text", "lang", model)


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, all languages that count in it, and a confidence."""
    documents, model = _model(spark, folder)
    return language.identify(documents, "doc_id", "text", model).select("doc_id", "lang", "confidence", "languages")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of one language in every text."""
    documents, model = _model(spark, folder)
    found = language.identify(documents, "doc_id", "text", model)
    return found.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_links, p2_unmatched, p4_found, p4_quantiles, p7_found, p7_forest, p7_splits, p8_ids, p8_decoded,
        p9_containers, p9_report, p10_found, p10_languages, p10_segments,
    )
}

_RATIOS = """
with facts as (select distinct * from fct_readmissions where in_payment_file and excess_readmission_ratio is not null),
groups_ as (
    select facility_id, fiscal_year, peer_group from payment_adjustments
    qualify row_number() over (partition by facility_id, fiscal_year order by ingested_at desc, peer_group desc nulls last) = 1
),
ratios as (
    select fiscal_year, condition, cast(peer_group as bigint) as peer_group, excess_readmission_ratio, peer_group_median_err
    from facts join groups_ using (facility_id, fiscal_year) where peer_group is not null
)"""

SQL = {
    "p4_found": _RATIOS
    + """
select fiscal_year, condition, peer_group from ratios group by all
having abs(median(excess_readmission_ratio) - mode(peer_group_median_err)) > 0.01""",
    "p4_quantiles": _RATIOS
    + """
select fiscal_year, condition, peer_group, cast(p as double) as probability, n, round(q, 6) as quantile from (
    select fiscal_year, condition, peer_group, n, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) as p, unnest(qs) as q from (
        select fiscal_year, condition, peer_group, count(*) as n, quantile_cont(excess_readmission_ratio, [0.1, 0.25, 0.5, 0.75, 0.9]) as qs
        from ratios group by all))""",
    "p7_found": """
with recursive edges as (
    select old_facility_id as a, new_facility_id as b from ccn_changes where trim(old_facility_id) <> '' and trim(new_facility_id) <> ''
    union select new_facility_id, old_facility_id from ccn_changes where trim(old_facility_id) <> '' and trim(new_facility_id) <> ''
), reach as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
roots as (select a as facility_id, least(a, min(b)) as root from reach group by a)
select coalesce(root, f.facility_id) as group_id
from ml_penalty_features f left join roots r on f.facility_id = r.facility_id
where f.facility_id is not null
group by 1 having count(distinct nullif(lower(trim(split)), '')) > 1""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}

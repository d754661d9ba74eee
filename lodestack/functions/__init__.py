from lodestack.functions.values import (  # noqa: F401
    MARKERS,
    clean_county_name,
    clean_text,
    facility_number,
    fold_accents,
    is_marker,
    number_key,
    squash,
    to_date_us,
    to_number,
    try_number,
)

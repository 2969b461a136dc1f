"""The queries of this subpackage, and the SQL for those that SQL expresses."""

from __future__ import annotations

from . import centroids, codes, decontaminate, mixing, quality_rules, secrets, url_filter, warc
from .gam import quality_query
from .license_scan import license_query
from .minhash import near_duplicate_query
from .packing import packing_query
from .toxicity import toxicity_query

QUERIES = {
    "op1_toxicity": toxicity_query,
    "op2_near_duplicates": near_duplicate_query,
    "op3_quality_rules": quality_rules.quality_rules_query,
    "op4_secrets": secrets.secrets_query,
    "op5_decontamination": decontaminate.decontamination_query,
    "op6_packing": packing_query,
    "op7_quality_classifier": quality_query,
    "op8_licenses": license_query,
    "op9_url_filter": url_filter.url_filter_query,
    "op10_warc": warc.warc_query,
    "op11_mixing": mixing.mixing_query,
    "op12_centroids": centroids.centroid_query,
    "op13_vector_codes": codes.code_query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_mixing": mixing.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}

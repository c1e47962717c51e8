"""Operators of a training-data pipeline. Nothing else in this package imports them."""

from .bpe import op2_bpe
from .licenses import op4_license_scan
from .decontaminate import op5_benchmark_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .line_dedup import OP10_SQL, op10_line_dedup
from .pii import op8_pii_surrogates
from .quality import op3_quality_classifier
from .simhash import op7_simhash_near_dedup
from .suffix_dedup import op9_suffix_dedup
from .substring_dedup import op1_substring_dedup


def queries():
    return {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_quality_classifier, op4_license_scan, op5_benchmark_decontamination, op6_exact_dedup, op7_simhash_near_dedup, op8_pii_surrogates, op9_suffix_dedup, op10_line_dedup)}


def oracle_sql():
    return {"op6_exact_dedup": OP6_SQL, "op10_line_dedup": OP10_SQL}

"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .embedding_dedup import op2_embedding_dedup
from .license_scans import op1_license_scans
from .line_dedup import op5_line_dedup
from .mixing import op3_mixing
from .packing import op9_best_fit_packing
from .quality_rules import op6_quality_rules
from .sharding import op8_sharding
from .simhash_dedup import op4_simhash_dedup
from .suffix_dedup import op7_suffix_dedup
from .url_filters import op10_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scans, op2_embedding_dedup, op3_mixing, op4_simhash_dedup, op5_line_dedup, op6_quality_rules, op7_suffix_dedup, op8_sharding, op9_best_fit_packing, op10_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": oracles.license_sql(), "op2_embedding_dedup": oracles.EMBEDDING_SQL, "op3_mixing": oracles.MIXING_SQL, "op5_line_dedup": oracles.LINE_SQL, "op8_sharding": oracles.sharding_sql(), "op6_quality_rules": oracles.QUALITY_SQL, "op7_suffix_dedup": oracles.SUFFIX_SQL, "op10_url_filters": oracles.url_sql()}

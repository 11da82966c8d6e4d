"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .gif import op9_gif
from .merkle import OP11_SQL, op11_merkle
from .mixing import OP6_SQL, op6_mixing
from .packing import op3_packing
from .periodic import op12_periodic
from .quality import op7_quality
from .repair import op4_token_files
from .secrets import OP10_SQL, op10_secrets
from .sharding import op1_sharding
from .simhash import op5_simhash
from .suffix import op13_suffix_dedup
from .url_filter import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_gif": op9_gif,
    "op10_secrets": op10_secrets,
    "op11_merkle": op11_merkle,
    "op12_periodic": op12_periodic,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op6_mixing": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op10_secrets": OP10_SQL, "op11_merkle": OP11_SQL}

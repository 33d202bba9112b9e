"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, jaccard_join, quality_rules, warc
from .alignment import op12_alignment
from .bpe import op4_bpe
from .decontaminate import op3_decontamination
from .line_dedup import op2_line_dedup
from .pii import op8_pii
from .quality_model import op10_quality_classifier
from .rans import op9_rans
from .simhash import op13_simhash
from .substring_dedup import op1_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_bpe": op4_bpe,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_warc": warc.op6_warc,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_pii": op8_pii,
        "op9_rans": op9_rans,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_collocations": collocations.op11_collocations,
        "op12_alignment": op12_alignment,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": jaccard_join.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op7_quality_rules": quality_rules.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL}

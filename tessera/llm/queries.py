"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.kd_shards import op1_kd_shards
from tessera.llm.language_id import op3_language_id
from tessera.llm.license_scan import op6_license_scan
from tessera.llm.matroska import op8_matroska
from tessera.llm.ngram_join import op4_ngram_join
from tessera.llm.packing import op10_best_fit_packing
from tessera.llm.secret_scan import op9_secret_scan
from tessera.llm.sp_tokenizer import op7_sentencepiece
from tessera.llm.token_counts import op5_token_counts
from tessera.llm.topk_search import OP2_SQL, op2_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_shards,
        op2_topk_search,
        op3_language_id,
        op4_ngram_join,
        op5_token_counts,
        op6_license_scan,
        op7_sentencepiece,
        op8_matroska,
        op9_secret_scan,
        op10_best_fit_packing,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_topk_search": OP2_SQL}

"""The registered queries of the text operators. Lexical search has an oracle in SQL; tests hold each other one against a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallsmith.llm.chat import op2_chat_formatting
from recallsmith.llm.decontam import op4_benchmark_decontamination
from recallsmith.llm.lang_id import op1_language_id
from recallsmith.llm.lexical import OP11_SQL, op11_lexical_search
from recallsmith.llm.near_dup import op8_simhash_near_dup
from recallsmith.llm.ngram_lm import op10_lm_scores
from recallsmith.llm.packing import op7_best_fit_packing
from recallsmith.llm.pii import op6_pii_spans
from recallsmith.llm.quality import op5_host_quality_rules
from recallsmith.llm.rans import op3_token_files
from recallsmith.llm.secret_scan import op13_secret_scan
from recallsmith.llm.toxicity import op9_toxicity_severity
from recallsmith.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_chat_formatting,
        op3_token_files,
        op4_benchmark_decontamination,
        op5_host_quality_rules,
        op6_pii_spans,
        op7_best_fit_packing,
        op8_simhash_near_dup,
        op9_toxicity_severity,
        op10_lm_scores,
        op11_lexical_search,
        op12_embedding_whitening,
        op13_secret_scan,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_lexical_search": OP11_SQL}

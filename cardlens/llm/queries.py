"""Registry of the corpus operators: query name -> callable, and their SQL."""

from __future__ import annotations

from cardlens.llm.alignment import op12_tokenizer_alignment
from cardlens.llm.brown import op2_brown_lm
from cardlens.llm.concat import op13_concat_packing
from cardlens.llm.decontamination import op10_cgk_decontamination
from cardlens.llm.language import op3_subword_langid
from cardlens.llm.minhash import op7_bbit_minhash
from cardlens.llm.oracle import ORACLE_SQL
from cardlens.llm.packing import op4_best_fit_packing
from cardlens.llm.periodic import op11_periodic_runs
from cardlens.llm.pii import op1_contextual_pii
from cardlens.llm.quality import op8_importance_resampling
from cardlens.llm.substring import op5_substring_dedup
from cardlens.llm.topk import op6_va_file
from cardlens.llm.warc import op9_warc

QUERIES = {
    "op1_contextual_pii": op1_contextual_pii,
    "op2_brown_lm": op2_brown_lm,
    "op3_subword_langid": op3_subword_langid,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_va_file": op6_va_file,
    "op7_bbit_minhash": op7_bbit_minhash,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_warc": op9_warc,
    "op10_cgk_decontamination": op10_cgk_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_concat_packing": op13_concat_packing,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

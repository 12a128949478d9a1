"""The registered queries of this subpackage and their SQL; None of the SQL where SQL can't say it."""

from __future__ import annotations

import corpus_pipeline
from glyphmark.llm.decontaminate import OP1_SQL, op1_decontaminate
from glyphmark.llm.htmltext import op9_html_text
from glyphmark.llm.linededup import OP3_SQL, op3_line_dedup
from glyphmark.llm.minhash import OP2_SQL, op2_minhash_forest
from glyphmark.llm.mixing import OP7_SQL, op7_mix_sources
from glyphmark.llm.secrets import op8_secret_scan
from glyphmark.llm.spelling import OP12_SQL, op12_spelling_variants
from glyphmark.llm.substrings import OP4_SQL, op4_substring_dedup
from glyphmark.llm.surrogates import op10_pii_surrogates
from glyphmark.llm.toxicity import op6_toxicity
from glyphmark.llm.urlfilter import OP13_SQL, op13_url_filter
from glyphmark.llm.vectors import OP5_SQL, op5_embedding_range_join
from glyphmark.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_range_join": op5_embedding_range_join,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_text": op9_html_text,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filter": op13_url_filter,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op2_minhash_forest": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_embedding_range_join": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidecast.llm.align import op11_tokenizer_alignment
from tidecast.llm.audit import OP13_SQL, op13_filter_audit
from tidecast.llm.classify import op6_quality_classifier
from tidecast.llm.decontaminate import op5_decontamination
from tidecast.llm.html import op7_html_extraction
from tidecast.llm.minhash import op8_minhash_near_dedup
from tidecast.llm.packing import op3_packing
from tidecast.llm.quality import op4_quality_rules
from tidecast.llm.secrets import op9_secret_scan
from tidecast.llm.sharding import OP12_SQL, op12_sharding
from tidecast.llm.tokenfile import op2_token_file
from tidecast.llm.urls import OP10_SQL, op10_url_filter
from tidecast.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_file": op2_token_file,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_html_extraction": op7_html_extraction,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_sharding": op12_sharding,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {
    "op1_warc": OP1_SQL,
    "op10_url_filter": OP10_SQL,
    "op12_sharding": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}

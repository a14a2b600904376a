"""Queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from siltstone.llm.decontaminate import OP9_SQL, op9_decontamination
from siltstone.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from siltstone.llm.langid import op8_langid
from siltstone.llm.line_dedup import op3_line_dedup
from siltstone.llm.mixing import OP2_SQL, op2_mixing
from siltstone.llm.ngram_join import op6_ngram_join
from siltstone.llm.sharding import op7_sharding
from siltstone.llm.suffix_dedup import op4_suffix_dedup
from siltstone.llm.url_filter import op10_url_filter
from siltstone.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_ngram_join": op6_ngram_join,
    "op7_sharding": op7_sharding,
    "op8_langid": op8_langid,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op5_warc": OP5_SQL, "op9_decontamination": OP9_SQL}

"""The queries of the corpus operators and their SQL."""

from trigrove.llm.op1_substring import op1_substring
from trigrove.llm.op2_url_filter import SQL as SQL2
from trigrove.llm.op2_url_filter import op2_url_filter
from trigrove.llm.op3_media import op3_media
from trigrove.llm.op4_quality import op4_quality
from trigrove.llm.op5_mixing import SQL as SQL5
from trigrove.llm.op5_mixing import op5_mixing
from trigrove.llm.op6_ann import op6_ann
from trigrove.llm.op7_sharding import op7_sharding
from trigrove.llm.op8_simhash import op8_simhash
from trigrove.llm.op9_packing import op9_packing
from trigrove.llm.op10_suffix_array import op10_suffix_array
from trigrove.llm.op11_centroids import SQL as SQL11
from trigrove.llm.op11_centroids import op11_centroids
from trigrove.llm.op12_toxicity import op12_toxicity
from trigrove.llm.op13_codes import SQL as SQL13
from trigrove.llm.op13_codes import op13_codes

QUERIES = {f.__name__: f for f in (op1_substring, op2_url_filter, op3_media, op4_quality, op5_mixing, op6_ann, op7_sharding, op8_simhash, op9_packing, op10_suffix_array, op11_centroids, op12_toxicity, op13_codes)}
ORACLES = {"op2_url_filter": SQL2, "op5_mixing": SQL5, "op11_centroids": SQL11, "op13_codes": SQL13}

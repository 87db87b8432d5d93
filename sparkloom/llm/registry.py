"""Queries of this subpackage and their SQL."""

from .alignment import op12_alignment
from .ann import op1_ann
from .langid import op8_langid
from .merkle import OP6_SQL, op6_merkle
from .mixing import OP10_SQL, op10_mixing
from .morton import OP11_SQL, op11_morton
from .neardup import op4_neardup
from .ngramjoin import op13_ngramjoin
from .packing import op9_packing
from .passages import op2_passages
from .secrets import op3_secrets
from .sharding import op7_sharding
from .suffixes import op5_suffixes

QUERIES = {"op2_passages": op2_passages, "op5_suffixes": op5_suffixes, "op4_neardup": op4_neardup, "op1_ann": op1_ann, "op8_langid": op8_langid, "op9_packing": op9_packing, "op3_secrets": op3_secrets, "op6_merkle": op6_merkle, "op7_sharding": op7_sharding, "op10_mixing": op10_mixing, "op11_morton": op11_morton, "op12_alignment": op12_alignment, "op13_ngramjoin": op13_ngramjoin}
ORACLE_SQL = {"op6_merkle": OP6_SQL, "op10_mixing": OP10_SQL, "op11_morton": OP11_SQL}

"""The registered queries of this subpackage and their DuckDB SQL."""

from logweir.llm import queries_data as data
from logweir.llm import queries_models as models

QUERIES = {
    f.__name__: f
    for f in (data.op1_token_output, data.op2_packing, data.op3_mixing, data.op4_media, models.op5_pii, models.op6_nearest, models.op7_toxicity, models.op8_near_duplicates, models.op9_quality, data.op10_sharding)
}
ORACLES: dict[str, str] = {}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

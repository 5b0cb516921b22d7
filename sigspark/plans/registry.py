"""All registered queries and their SQL oracles."""
from __future__ import annotations

from . import audit_q, features_q, labels_q, metrics_q, ml_q, pe_decode_q, pe_q, prepare_q, stream_q

_MODULES = [features_q, audit_q, labels_q, metrics_q, pe_q, ml_q, stream_q, prepare_q, pe_decode_q]

QUERIES = {}
ORACLE = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)


def flagship(spark, sf_dir):
    return features_q.q_byte_summary(spark, sf_dir)

"""Queries of this subpackage and their SQL."""

from . import bitplane, conversations, filter_audit, hyperplane, knn, langid, lmscore, mixing, ngram_join, packing, quality, sharding, wrappers

QUERIES = {
    "op1_forest": ngram_join.op1_forest,
    "op2_mix": mixing.op2_mix,
    "op3_xent": lmscore.op3_xent,
    "op4_langid": langid.op4_langid,
    "op5_wrappers": wrappers.op5_wrappers,
    "op6_lines": quality.op6_lines,
    "op7_voronoi": knn.op7_voronoi,
    "op8_shards": sharding.op8_shards,
    "op9_bitplanes": bitplane.op9_bitplanes,
    "op10_pack": packing.op10_pack,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_hyperplanes": hyperplane.op12_hyperplanes,
    "op13_conversations": conversations.op13_conversations,
}
ORACLE = {"op2_mix": mixing.SQL, "op3_xent": lmscore.SQL, "op6_lines": quality.SQL, "op7_voronoi": knn.SQL, "op8_shards": sharding.SQL, "op11_filter_audit": filter_audit.SQL, "op12_hyperplanes": hyperplane.SQL, "op13_conversations": conversations.SQL}

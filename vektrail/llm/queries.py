"""The pN_ queries of this package and their DuckDB twins."""

from __future__ import annotations

from vektrail.llm.clusters import p4_clusters, p4_found
from vektrail.llm.encode import p6_ids
from vektrail.llm.fusion import p1_found, p1_ranking
from vektrail.llm.mixing import p7_found, p7_mix, p7_report
from vektrail.llm.neardup import p5_found, p5_groups
from vektrail.llm.neighbors import p3_found
from vektrail.llm.oracles import ORACLES
from vektrail.llm.reading import p8_found

QUERIES = {
    "p1_found": p1_found,
    "p1_ranking": p1_ranking,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
}

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries of the subpackage."""

from panelwright.llm import (  # noqa: F401
    chat,
    chunk_dedup,
    collocations,
    decontaminate,
    jaccard,
    kneser_ney,
    licenses,
    line_dedup,
    mixing,
    periodic_runs,
    quality,
    sharding,
    token_files,
)
from panelwright.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

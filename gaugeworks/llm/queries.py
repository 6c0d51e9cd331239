"""All queries of the subpackage; importing the modules registers them."""

from gaugeworks.llm import (  # noqa: F401
    alignment, chat, codes, decontamination, language, licenses, linededup, packing, sharding, simhash, topk, toxicity,
    urlfilter,
)
from gaugeworks.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

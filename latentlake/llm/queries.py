"""All queries of the subpackage, registered by importing its operators."""

from . import decontam, jaccard, licences, mixing, periodic, quality, simhash, spelling, suffixes, surrogates, tokens, warc, winnowing  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

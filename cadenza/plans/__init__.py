"""The library's queries over the standard tables."""

from . import catalogue, checks, cleaning, collabs, fingerprints, lexical, library, reports, rhymes, suggestions, summaries, tracks
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalogue", "checks", "cleaning", "collabs", "fingerprints", "lexical", "library", "reports", "rhymes", "suggestions", "summaries", "tracks"]

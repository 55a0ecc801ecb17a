"""reviewlake: customer-review analytics as Spark DataFrame jobs.

Subpackages:
  sources    captured pages, review files, sinks
  functions  Column-level helpers (tokens, casts, masking, prompts)
  operators  DataFrame -> DataFrame operators (lexicon scoring, stats,
             chunking, indexing, retrieval, batch scoring, dedupe)
  plans      composed jobs (review table, company summary, report, catalog)
  streaming  Structured Streaming variants of dedupe and trends
"""

from reviewlake.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]

"""ticketlens: support-ticket triage and analytics as Spark DataFrame jobs.

Layout
------
sources/    readers, writers, validation and the test-table adapters
functions/  column expressions (text builders, rounding, bands, prompts)
operators/  DataFrame -> DataFrame operators (analytics, TF-IDF, kNN,
            linear scoring, metrics, split, training, review state)
plans/      composed entry points registered as queries, plus their
            DuckDB oracle SQL
streaming/  Structured Streaming re-aims of the request/response paths
"""

__version__ = "0.1.0"

"""Operators of a training-data pipeline, one module per operator, plus the
registered queries (``queries``) and their DuckDB SQL (``oracle``).

Nothing outside this subpackage imports it, except the guarded
registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""

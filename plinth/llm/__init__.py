"""Training-data operators: each module is one operator with its own interface.

``registry.py`` holds the queries and their SQL; nothing outside this
subpackage imports it except ``__spark_entry__.py`` (behind a guard) and
``corpus_pipeline.py``.
"""

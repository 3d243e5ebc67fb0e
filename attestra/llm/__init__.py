"""Training-data operators: archives, sharding, quality, duplicates, mixing, search, toxicity, leaks.

``QUERIES`` maps ``opN_<name>`` to a callable ``(spark, sf_dir) -> DataFrame``;
``ORACLES`` holds DuckDB SQL for those that SQL can express on whole tables.
Nothing outside this package imports it, bar the guarded hook in ``__spark_entry__``.
"""

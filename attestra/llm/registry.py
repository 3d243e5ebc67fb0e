"""Queries of this package and their DuckDB SQL, as the entry module lists them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that defines it.
_WHERE = {
    "op1_warc_revisits": "warc",
    "op2_external_shuffle": "sharding",
    "op3_quality_sites": "quality",
    "op4_linear_grouping": "suffixdedup",
    "op5_jaccard_components": "jaccard",
    "op6_source_mix": "mixing",
    "op7_fingerprint_index": "substrings",
    "op8_pruned_graph": "ann",
    "op9_toxicity": "toxicity",
    "op10_benchmark_leaks": "decontamination",
}
_SQL = {"op1_warc_revisits": "warc", "op7_fingerprint_index": "substrings"}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracles() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{module}").ORACLE for name, module in _SQL.items()}

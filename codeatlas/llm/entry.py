"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that defines it
_HOME = {
    "op1_substring_dedup": "substring_dedup",
    "op2_packing": "packing",
    "op3_topk": "topk",
    "op4_toxicity": "toxicity",
    "op5_line_dedup": "line_dedup",
    "op6_mixing": "mixing",
    "op7_fingerprints": "fingerprints",
    "op8_warc": "warc",
    "op9_near_dedup": "near_dedup",
    "op10_licenses": "licenses",
}


def _lazy(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{_HOME[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _lazy(name) for name in _HOME}


def oracle_sql() -> dict[str, str]:
    homes = {name: import_module(f"{__package__}.{home}") for name, home in _HOME.items()}
    return {name: home.ORACLE for name, home in homes.items() if getattr(home, "ORACLE", None)}

"""Operators of large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface, its thin ``query`` and, where SQL can say
it, the ``ORACLE`` text.
"""

from importlib import import_module

_MODULES = {
    "op1_token_frames": "token_files",
    "op2_toxicity": "toxicity",
    "op3_token_counts": "token_counts",
    "op4_chat_format": "chat",
    "op5_sentencepiece": "pieces",
    "op6_source_mixing": "mixing",
    "op7_html_text": "html_text",
    "op8_near_duplicates": "near_dup",
    "op9_winnowing": "winnow",
    "op10_nearest_vectors": "neighbours",
}


def queries():
    """Query name -> callable(spark, sf_dir)."""
    found = {name: import_module(f"{__name__}.{module}").query for name, module in _MODULES.items()}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    """Query name -> DuckDB SQL, for the operators that SQL can express."""
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

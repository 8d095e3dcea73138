"""Text retrieval and context packing as Spark plans.

``functions``  column expressions; ``sources``  files, tables and the stored
index; ``operators``  chunking, indexing, scoring, re-ranking, packing,
expansion and code analysis over DataFrames; ``plans``  the query catalogue and
the engine facade; ``streaming``  continuous index maintenance.
"""

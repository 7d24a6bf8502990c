"""Operations of a training-data pipeline: scoring, scanning, sharding, archiving, deduplication, packing, search and mixing.

Nothing outside this subpackage (but corpus_pipeline.py and the guarded import in __spark_entry__.py) imports it.
"""

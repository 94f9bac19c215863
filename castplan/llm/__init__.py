"""Training-data operators: ten corpus operations as Spark jobs, with their registered queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Each module is one
operator with a general interface; ``queries.py`` derives the registered result columns.
"""

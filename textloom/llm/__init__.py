"""Operations of a training-data pipeline: deduplication, scoring, filtering, tokens.

Every module offers a general operator (DataFrame in, DataFrame out); the thin
``opN_*`` queries over the standard tables are in :mod:`textloom.llm.queries`.
"""

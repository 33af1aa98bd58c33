"""No streaming operator: the corpora are finite files.

The row-wise expressions of ``corpusloom.functions`` and the projections of ``operators.extract`` and
``operators.crosstab.typed_questions`` hold no state, so they run unchanged on a ``readStream`` frame.
"""

"""Spark DataFrame operators for curating and profiling table question-answering corpora."""

"""Training-data operators: ten jobs over documents, embeddings and pages.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""

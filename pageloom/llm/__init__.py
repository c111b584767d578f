"""Training-data operators: ten building blocks of a text corpus pipeline.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""

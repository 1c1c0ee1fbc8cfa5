"""Operators for preparing large language-model training corpora.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only
when it is present.
"""

"""Operators for preparing language-model training text, each a Spark job.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""

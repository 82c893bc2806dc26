"""Operators for building training corpora: one module for each operator.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
that ``__spark_entry__.py`` adds when the subpackage is present.
"""

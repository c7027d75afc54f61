"""Operators for building training corpora at scale.

Each module holds one operator with a general interface; ``entries`` holds the thin queries
over the test tables and, where SQL can express them, their SQL. Nothing outside this
subpackage imports it.
"""

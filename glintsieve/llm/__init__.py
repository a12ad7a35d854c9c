"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` binds them to the registered queries.
"""

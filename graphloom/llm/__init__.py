"""Operators for preparing large text corpora for language-model training.

Each module holds one operator with its own general interface; ``queries`` binds the
operators to the test tables.  Nothing outside this subpackage imports it.
"""

"""Operators for preparing large text corpora; nothing outside this package imports it.

Each module holds one operator with a general interface; ``queries`` binds them to the test tables.
"""

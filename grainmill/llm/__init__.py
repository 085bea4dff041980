"""Operators for building large text training sets.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` applies them to the test tables.
"""

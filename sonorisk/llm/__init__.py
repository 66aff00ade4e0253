"""Operators for preparing training data at corpus scale, with their queries and reference SQL.

Nothing else in the library imports this subpackage.
"""

"""Operators for preparing training data, their queries and the SQL that checks them.

Nothing else in the package imports this folder.
"""

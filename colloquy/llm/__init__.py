"""Operators for preparing training text at corpus scale.

Every operator takes and returns DataFrames. Nothing else in the library
imports this package; ``queries.py`` registers one query per operator.
"""

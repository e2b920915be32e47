"""Operators for preparing training text: one module for each, and ``queries`` for the registry.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames, reads only the
columns it names (other columns may have any name), and gives a defined result for nulls, empty tables
and repeated rows, which its docstring states.
"""

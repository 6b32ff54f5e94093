"""Operators for preparing training text, each beside the general library.

Nothing outside this subpackage imports it.  Every operator handles NULL in any
column, empty and very long texts, repeated rows and empty tables; what it
returns for them stands in its docstring.
"""

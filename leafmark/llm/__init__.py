"""Operators for preparing language-model training text at cluster scale.

Every operator takes a documents DataFrame plus the names of its id and text
columns, reads only those columns (extra columns never clash, unless a stage
passes rows through, which keeps them unchanged), and returns one row per
document unless its docstring says otherwise.
"""

"""Training-data operators: ten DataFrame operators and the queries that apply them.

Nothing outside this subpackage imports it.
"""

"""Training-data operators: ten corpus-scale operators and their registered queries.

Nothing outside this subpackage imports it.
"""

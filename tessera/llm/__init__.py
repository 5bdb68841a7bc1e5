"""Training-data operators: ten corpus operators and their registered queries.

Nothing else in the package imports this subpackage.
"""

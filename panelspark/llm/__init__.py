"""Training-data operators: ten stand-alone DataFrame operators and their registered queries.

Nothing else in the library imports this subpackage.
"""

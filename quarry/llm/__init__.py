"""Training-data pipeline operators.

Nothing else in the package imports this subpackage; the entry module adds its
queries only when it can be imported.
"""

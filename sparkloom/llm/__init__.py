"""Training-data operators: each module holds one operator over DataFrames.

Nothing outside this subpackage imports it.
"""

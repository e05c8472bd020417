"""Training-data operators: each module holds one, ``queries`` registers them.

Nothing outside this subpackage imports it.
"""

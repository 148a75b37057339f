"""Training-data operators: ten corpus operations on ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it; ``queries`` registers its thin queries.
"""

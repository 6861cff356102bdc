"""Training-data operators for very large text collections.

Each module holds one operator with a general interface; ``queries`` derives the
registered ``opN_*`` results from them.
"""

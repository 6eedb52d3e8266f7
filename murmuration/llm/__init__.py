"""Training-data operators: near-dedup, token work, packing, filtering.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""

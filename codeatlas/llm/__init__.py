"""Training-data operators (dedup, packing, search, scoring, archives).

Nothing outside this subpackage imports it; ``llm.entry`` lists its queries.
"""

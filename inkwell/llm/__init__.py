"""Training-data operators: deduplication, mixing, packing, filtering, counting and redaction.

Nothing else in the package imports this subpackage. ``inkwell.llm.queries`` holds the
registered queries and ``inkwell.llm.oracles`` their SQL.
"""

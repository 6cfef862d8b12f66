"""Training-data operators.

Ten operators over ``documents`` and ``conversations``, their contract queries
(:mod:`tallywick.llm.queries`) and the DuckDB twins of those that SQL can
express (:mod:`tallywick.llm.oracles`).  Nothing outside this subpackage
imports it.
"""

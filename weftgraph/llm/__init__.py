"""Operators for preparing training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`weftgraph.llm.queries` binds
them to the driver's tables.
"""

"""Operators for training data: repeated lines, scan repair, broken pairs, packing, leaks and subjects.

Nothing outside this folder imports it; its queries are in ``leafmill.llm.queries``.
"""

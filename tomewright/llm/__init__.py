"""Operators for preparing training text: one module for each problem, their queries in :mod:`tomewright.llm.queries`."""

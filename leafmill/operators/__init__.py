"""Operators on DataFrames: splitting, ranking, vectors, joins by range, budgets, planning, grading and progress."""

"""Whole-table plans: replay of command logs, atomic batches."""

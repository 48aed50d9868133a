"""Composed jobs: the reconciliation batch, reports, quality and evaluation jobs."""

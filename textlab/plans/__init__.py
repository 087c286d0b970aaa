"""Composed jobs: fit, evaluate, session, cross-validation, search, experiment."""

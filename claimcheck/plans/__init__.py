"""Whole runs composed from the operators: verify, evaluate, roll back."""

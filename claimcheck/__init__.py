"""Checks what a data catalog says about tables against the tables, on Spark."""

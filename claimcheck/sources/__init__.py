"""Readers and writers: warehouse tables, stored completions, run outputs."""

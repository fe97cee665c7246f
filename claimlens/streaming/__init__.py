"""Incremental loading of extract files as they arrive."""

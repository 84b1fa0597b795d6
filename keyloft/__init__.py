"""Typed key-value semantics over whole datasets, expressed as Spark plans."""

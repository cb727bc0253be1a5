"""Binding of the given tables to the engine, the registered queries and their SQL."""

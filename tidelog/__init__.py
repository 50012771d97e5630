"""A PySpark engine for append-only event logs: streams as ordered tables of messages."""

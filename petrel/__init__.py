"""Petrel: address-space, event-log and retrieval analytics on PySpark."""

"""Lectern: evidence, item-bank and document-corpus analytics on PySpark."""

"""Curation of labelled sequence and text records as PySpark DataFrame operators."""

"""Operators for training-data pipelines: decontamination, deduplication, packing, filters and scans.

Every operator takes a DataFrame and the names of its columns and returns a DataFrame. Columns it does not need are never
read, so extra columns cannot clash. Rows are identified by the id column together with the text: a null id is an ordinary
value, and rows that repeat an id with another text are separate documents.
"""

"""Operators of a training-data pipeline: de-duplication, packing, decontamination, search, scoring and archives.

Nothing else in the library imports this subpackage. ``queries.queries()`` holds its registered queries.
"""

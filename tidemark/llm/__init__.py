"""Training-data operators: filtering, de-duplication, mixing, packing and storage of text corpora.

Every operator takes and returns DataFrames. Queries for the driver are in ``queries``.
"""

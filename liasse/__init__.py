"""liasse: document-corpus analytics as Spark jobs.

Pages, chunks, queries and persons are DataFrames; every operator takes
DataFrames and returns DataFrames, over all cases at once.
"""

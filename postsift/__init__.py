"""Fraud analytics over job postings, written as Spark DataFrame jobs.

``functions`` hold column expressions, ``sources`` read and write tables,
``operators`` turn DataFrames into DataFrames, ``plans`` chain them into whole
jobs and ``streaming`` runs the scoring plan over a stream. Nothing here starts
a Spark session: every entry point takes DataFrames or a session.
"""

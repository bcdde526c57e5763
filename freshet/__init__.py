"""Sets of derived tables kept fresh with Spark.

A *definition* is a named ``select`` with an optional refresh interval and
settings.  The package finds what each definition reads, decides what is due,
rebuilds due tables in dependency order behind data tests, keeps snapshots and
reports on the run log.  Everything that grows with the data is a DataFrame job.
"""

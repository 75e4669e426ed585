"""claimweave: reconcile documented care with coded and billed claims, as Spark jobs.

Operators take DataFrames and return DataFrames.  Checks return ``(ok, rejects)``
where ``rejects`` carries a ``violations ARRAY<STRING>`` column.  Nothing is
collected to the driver and the clock is always an argument.
"""

__version__ = "0.1.0"

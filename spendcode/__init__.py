"""spendcode: coding purchase records with Spark DataFrame jobs.

Modules are grouped by role:

* ``functions``  -- Column expressions (text cleaning, parsers, fuzzy scores, vectors).
* ``sources``    -- readers and writers (CSV with pandas-compatible quoting, Parquet tables).
* ``operators``  -- DataFrame-to-DataFrame building blocks (dedupe, best match, response store).
* ``plans``      -- end-to-end jobs composed from the operators (enrich, process, catalogue, embed).
* ``streaming``  -- the enrich chain run incrementally with ``foreachBatch``.
"""

__version__ = "0.1.0"

"""Hierarchical demand forecasting and scoring on Spark DataFrames.

Layout
------
``schema``      column contracts of every table the library exchanges
``session``     session defaults, shared checkpoint folder, checked broadcasts
``functions``   column expressions (null rules, ids, calendar flags, arrays)
``sources``     readers, writers and the order-book demand view
``operators``   DataFrame -> DataFrame building blocks
``models``      pooled models fitted as Spark jobs
``plans``       end-to-end compositions (score, forecast, assemble)
"""

__version__ = "0.1.0"

"""cohortlens — cohort and case-outcome analytics expressed as Spark DataFrame plans.

Layout:
  functions/  Column-level building blocks (bands, keywords, intervals, exact rounding)
  operators/  DataFrame-level operators (interval joins, metrics, ingest jobs, quality, catalog)
  sources/    Table bindings, CSV/JSON sources and sinks
  plans/      Registered reports and operator queries, plus their SQL oracles

"""

__version__ = "0.1.0"

"""quarry: table profiling, relationship discovery, star-join models, KPI
measures, summaries and chart data as Spark DataFrame jobs.

Entry points (all take and return DataFrames):

* :func:`quarry.operators.profile.prepare` / ``profile`` - clean names,
  infer and coerce types, profile columns;
* :func:`quarry.operators.relationships.infer_relationships` and
  :func:`quarry.operators.model.build_model` - keys and the analysis table;
* :func:`quarry.operators.measures.add_measures` - KPI columns;
* :mod:`quarry.operators.summary`, :mod:`quarry.operators.charts`,
  :mod:`quarry.plans.chart_plan`, :mod:`quarry.operators.answers`,
  :mod:`quarry.operators.audit`.
"""

__version__ = "0.1.0"

"""Text corpus analytics on Spark.

Operators take and return DataFrames (``op(df, ..., *, params)``):

* ``operators.corpus``: snapshot difference, length filter, html text,
  sections, links, keep-last, chunking with continuous ids;
* ``operators.sparse`` / ``operators.dense``: per-article TF-IDF, BM25 and
  dot-product top-k, nesting, coverage, encoders;
* ``operators.shaping``: section filters, numbered context, token budgets,
  writer messages, response parsing and ordered regrouping;
* ``operators.overlap`` / ``operators.citations`` / ``operators.judge``:
  BLEU, METEOR, ROUGE-L, citation recall/precision, judge scores;
* ``sources`` / ``streaming``: file readers and writers, incremental ingest.

``plans.catalog.QUERIES`` holds the registered queries over the given tables.
"""

"""credlake: a Spark-native article-credibility lake.

Raw news payloads or envelope streams become bronze/silver/gold Parquet
layers; every article is scored; scored rows are merged by id; and the
questions asked of the result (totals, rates, top sources, timelines,
pages, feeds, display text, classifier data and metrics) are ordinary
DataFrame / SQL / Structured Streaming operators.

Sub-packages
------------
functions  Column -> Column expressions (ids, text, time, scoring, display)
sources    readers, envelope codecs, payload normalisers, lake layers, fixtures
operators  batch operators (clean, score, merge, stats, feed, evaluate, train)
streaming  Structured Streaming jobs (bronze, silver, score, chain, live aggs)
plans      the named query catalogue and its DuckDB oracle SQL
"""

__version__ = "0.1.0"

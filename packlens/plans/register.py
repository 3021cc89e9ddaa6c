"""All queries of the engine and their SQL."""

from packlens.plans import label_queries, model_queries, photo_queries, reports

_ALL = (reports, label_queries, photo_queries, model_queries)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}

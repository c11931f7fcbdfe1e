"""All queries of the core and their SQL, by name."""

from lodestream.plans import daily, q_bulletins, q_documents, q_evaluation, q_relational, q_retrieval

_MODULES = (daily, q_bulletins, q_documents, q_retrieval, q_evaluation, q_relational)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

"""Queries of this subpackage and their SQL."""

from . import ann, decontaminate, htmltext, langid, packing, sharding, simhash, suffixdedup, toxicity, urlfilter

_ALL = (packing, suffixdedup, sharding, htmltext, urlfilter, ann, langid, toxicity, simhash, decontaminate)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.SQL.items()}

"""All queries of the core and their SQL."""

from skein.plans import content, corpus, formats, frontier, links, outcomes, pipeline, store, streams, urls

MODULES = (corpus, urls, links, content, frontier, outcomes, formats, streams, pipeline, store)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}

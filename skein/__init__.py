"""Crawl-data analytics on Spark: link extraction, scope, de-duplication, frontier reports and corpus operators."""

"""Workload jobs (``jobs``) and the registered queries with their SQL (``catalog``)."""

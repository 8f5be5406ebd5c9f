"""Registered queries, by module: ``QUERIES`` and ``SQL`` of each."""

from . import data, engine, features

MODULES = [data, features, engine]
FLAGSHIP = "pit_orders_per_customer"

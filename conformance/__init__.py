"""Queries over the driver's sample tables and their SQL oracles; test scaffolding around the library."""

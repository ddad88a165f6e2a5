"""Registered queries: each is a Spark plan over the test tables plus the
equivalent DuckDB SQL used as a correctness oracle."""

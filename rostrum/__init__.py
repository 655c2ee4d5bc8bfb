"""Rostrum: hearing-discourse analytics as Spark DataFrame operators."""

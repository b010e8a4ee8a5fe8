"""Scalar functions built from Spark SQL column expressions."""

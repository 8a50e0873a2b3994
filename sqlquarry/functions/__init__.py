"""Scalar functions, all as Column expressions that stay in the JVM."""

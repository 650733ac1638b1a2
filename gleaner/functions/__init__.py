"""Scalar functions as Column expressions; none of them leaves the JVM."""

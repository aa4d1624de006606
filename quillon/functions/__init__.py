"""Scalar expressions that stay in the JVM."""

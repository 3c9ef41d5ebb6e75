"""Spark-first corpus analytics and retrieval engine.

Every operator is a ``DataFrame -> DataFrame`` function: it declares a plan and leaves the
physical strategy to Catalyst and AQE.
"""

"""Spark ML stages, feature plans, models and experiments built from them."""

"""Clustering, churn models and explanations on Spark ML and SQL."""

"""Workload-diagnosis analytics and training-data operators on Spark."""

"""Spark-first analytics over companies, periods, pay, jobs and visitor events."""

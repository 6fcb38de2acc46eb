"""Recall and analytics over work history, written as Spark DataFrame operators."""

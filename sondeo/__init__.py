"""Automated tabular analysis written as Spark DataFrame operators."""

"""Finds, explains, groups and redacts leaked credentials in logs and text, on Spark."""

"""Sievelight: a Spark analytics engine that audits executable web content."""

"""Curation, balancing, auditing and evaluation of labelled text and code tables on Spark."""

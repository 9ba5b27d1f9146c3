"""Quern: curation, audit and analysis of game records and corpora on Spark."""

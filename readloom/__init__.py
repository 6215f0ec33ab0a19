"""readloom: interval analytics over sequencing-read alignments, planned by Spark."""

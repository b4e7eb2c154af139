"""Pairwise measurement on Spark: pairing, judging, scoring and rater validation as DataFrame plans."""

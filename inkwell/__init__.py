"""Prepare text prompts for batch completion, and analyse the answers, on Spark."""

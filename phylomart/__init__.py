"""Taxon, trait, occurrence and phylogeny operators for Spark DataFrames."""

"""Streams of site events and job ads: the same results as in batch, kept up as files arrive."""

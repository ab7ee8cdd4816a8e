"""Retail sales diagnostics as Spark jobs: profile, clean, classify, measure and explain sales lines."""

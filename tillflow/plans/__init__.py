"""Steps put together: cleaning, loading, reporting."""

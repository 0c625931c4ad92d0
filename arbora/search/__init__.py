"""Keyword, TF-IDF, vector and fused ranking."""

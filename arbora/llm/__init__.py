"""Training-data operators: filters, deduplication, extraction, formatting and tokenization.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and their SQL twins.
"""

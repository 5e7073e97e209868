"""Operators over the ledger's tables: DataFrame in, DataFrame out."""

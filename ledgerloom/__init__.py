"""Ledgerloom: receipts, invoices and bills as a Spark-native expense ledger."""

"""Ledgerwise: rank company filings for review, entirely on Spark DataFrames."""

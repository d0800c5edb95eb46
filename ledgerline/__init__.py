"""ledgerline: query flat record files, and prepare training text, with Spark."""

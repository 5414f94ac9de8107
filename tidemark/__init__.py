"""PySpark-native analytics engine: ledger, differential and text-to-relation operators."""

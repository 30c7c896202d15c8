"""ledgerlift: sales-report corpora to fact tables, and usage metering, as Spark jobs."""

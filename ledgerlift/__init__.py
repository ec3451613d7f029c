"""ERP analytics on Spark: exports in, checked, aggregated and searchable tables out."""

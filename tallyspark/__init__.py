"""Invoice, audit-log and training-corpus analytics expressed as Spark DataFrame plans."""

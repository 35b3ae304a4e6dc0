"""tessera: Spark operators that turn documents into instruction-tuning data and searchable knowledge."""

"""tessera: Spark-first analytics over two-cohort measurement matrices."""

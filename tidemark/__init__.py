"""tidemark: signal research, back-testing and corpus preparation as Spark DataFrame computations."""

"""quern: a Spark-first engine for ranking, learning from and cleaning collections of documents."""

"""furrow: Spark-first analytics over gridded, parcel and station tables."""

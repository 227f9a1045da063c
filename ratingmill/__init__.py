"""Sports-rating analytics on Spark, and corpus preparation in ``ratingmill.llm``."""

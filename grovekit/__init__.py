"""Spark-first analytics for collections of labelled rooted trees."""

"""Analytics on named geographic points, written for Spark's DataFrame and SQL interfaces."""

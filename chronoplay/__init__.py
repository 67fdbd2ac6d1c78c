"""Analytics over play histories, written as Spark DataFrame jobs for all users and periods at once."""

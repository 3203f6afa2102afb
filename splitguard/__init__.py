"""Train/test split checks for labelled tables, written as Spark DataFrame jobs."""

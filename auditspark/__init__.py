"""Investigation of audit logs and mail traces with Spark DataFrames."""

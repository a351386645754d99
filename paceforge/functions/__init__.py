"""Column expressions. Nothing in here touches a DataFrame or runs a job."""

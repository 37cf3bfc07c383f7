"""Column expressions: no function here touches a DataFrame or triggers a job."""

"""Column -> Column building blocks.  Nothing here runs a job."""

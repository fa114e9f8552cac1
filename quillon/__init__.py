"""quillon: entity-by-date panel analytics and relational audits on Spark DataFrames."""

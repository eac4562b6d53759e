"""txnlens: transaction analytics and anomaly scoring on Spark DataFrames."""

"""Primary-flow analytics for exchange-traded funds, built on Spark DataFrames."""

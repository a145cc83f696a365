"""colforest: dependency forests between the columns of a table, and what they are good for, on Spark."""

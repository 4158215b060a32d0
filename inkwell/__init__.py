"""Text-corpus building and detector evaluation on Spark DataFrames."""
